"""From raw documents to token ids: five stages, each one operator over all rows its predecessor kept.

Every stage reads whole texts of all its rows.  NULL texts are empty ones;
repeated rows are rows of their own except where a stage says otherwise; an
empty table gives an empty one; columns beyond those of ``documents`` stay
until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm import bpe, decontam, quality, simhash, surrogate
from crosstide.llm.catalog import SURROGATE_KEY, tokenizer_path
from crosstide.llm.common import free_name, table, written

#: SQL cannot express the stages; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on the labelled ones among them, scores at the cut or above.

    Empty and NULL texts have a score like any other; equal texts have equal
    scores, so copies stay or go together; without labels all documents stay.
    """
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.scored(docs, ranker, out=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest key; NULL keys stay only without another.

    Empty and NULL texts are one component; rows with the same key and text stay or go together.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; NULL and empty texts stay, NULL and empty items count for nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and lengths counted anew; NULL texts stay NULL, with a NULL length."""
    size = docs.schema["n_chars"].dataType
    return surrogate.protected(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast(size))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text decoded from them; NULL and empty texts have none and the empty text's."""
    packed = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("doc"), "text")
    out = bpe.encoded(packed, "doc", tokenizer_path())
    return out.select("doc.*", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
