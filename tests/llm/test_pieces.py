"""Piece encoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from crosstide.llm import catalog, pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "x", "xx", "the", " ", "  ", "   ", "▁", "\n", "\t", "é", "中国", "😀", "\x00", "�", "<s>", "<0x41>", "===", "---", "ing", "er", "12", "ion", " th", "QZ", "​", "한국", "вет", "ق", "\r\n", "\xa0", "ﬁ"]


def fixture():
    draw = random.Random(13)
    texts = []
    for _ in range(400):
        some = draw.sample(PARTS, draw.randint(1, 8)) if draw.random() < 0.6 else PARTS
        texts.append("".join(draw.choice(some) for _ in range(draw.choice([3, 10, 40, 200]))))
    letters = "etaoinshrdlu"
    texts += ["".join(draw.choice(letters[: draw.randint(2, 12)]) for _ in range(draw.randint(100, 1500))) for _ in range(60)]
    return [None, "", " ", "  a", "x" * 20_000, "ab" * 5_000, "=" * 3_000, " " * 5_000, "same", "same", *texts]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_text_equal_the_library(spark, library):
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit(0)).repartition(3)
    got = {r["doc_id"]: r for r in pieces.encoded(df, "doc_id", PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert got[i]["ids"] == ids, repr(text)[:200]
        assert got[i]["decoded"] == (library.decode(ids) if ids else "")


@pytest.mark.parametrize("rounds", [0, 3])
def test_the_queue_gives_the_same_symbols_as_rounds(library, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    model = pieces.Pieces(PATH)
    texts = [t or "" for t in fixture()]
    assert model.encode_texts([model.words(t) for t in texts]).to_pylist() == library.encode(texts)


def test_any_ids_decode_as_in_the_library(library):
    draw = random.Random(4)
    ids = [[draw.randrange(3, 259) if draw.random() < 0.5 else draw.randrange(259, 32_000) for _ in range(draw.randint(1, 12))] for _ in range(2_000)]
    got = pieces.Pieces(PATH).decode_texts(pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(one) for one in ids]


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op13_sentencepiece_round_trip(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()


def test_empty_table(spark):
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), "doc_id", PATH).count() == 0
