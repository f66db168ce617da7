"""The pipeline against a plain-Python version of its stages."""

import sys

import numpy as np
import public_tokenizers
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from crosstide.llm import decontam, quality, surrogate
from crosstide.llm.catalog import SURROGATE_KEY

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    ranker = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [d for d in docs if ranker.score(quality.features(d["text"])[None])[0] >= 0.7]
    names = slow_components([d["doc_id"] for d in kept], [slow_fingerprint(d["text"]) for d in kept], 4)
    kept = [d for d, n in zip(kept, names, strict=True) if d["doc_id"] == n]
    items = [(str(r["item_id"]), decontam.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def dirty(text):
        plain = decontam.normalised(text)
        return any(decontam.myers(decontam.letters_of(x), len(x), plain)[0] <= len(x) // 10 for _, x in items)

    kept = [d for d in kept if not dirty(d["text"])]
    assert 0 < len(kept) < len(docs)
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [d["doc_id"] for d in kept]
    for d in kept:
        text, _ = surrogate.replace(d["text"], lambda k, v: surrogate.surrogate(SURROGATE_KEY, k, v))
        assert got[d["doc_id"]]["ids"] == library.encode(text, add_special_tokens=False).ids and got[d["doc_id"]]["n_chars"] == len(text)


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "x" * 50_000, None, "s", 50_000)], docs.schema)
    for table in (docs.limit(20).unionAll(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == docs.columns
            table = spark.createDataFrame(table.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and np.__version__ and "crosstide.llm" in sys.modules
