"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crosstide.llm import bpe, catalog

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "B", "É", "é", "Σ", "σς", "İ", "ß", "'s", "'LL", "’s", "123", "½", "٣", "中文", "😀", "​", " ", "\t", "\n", "　", "\x85", " ", "!!!", "_", "ǅ", "ﬁ", "한국", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "the ", "tion", "ening"]


def fixture():
    draw = random.Random(4)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    return [None, "", " \n", "x" * 20_000, "ab" * 3_000, "!" * 999, "same", "same", *texts]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_padding()
    made.no_truncation()
    return made


@pytest.mark.parametrize("lexicon", [200_000, 3, 0])
def test_ids_and_text_equal_the_library(spark, library, lexicon):
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit(0)).repartition(3)
    got = {r["doc_id"]: r for r in bpe.encoded(df, "doc_id", PATH, lexicon_words=lexicon).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, repr(text)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op8_bpe_round_trip(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_transducer_is_exact_and_minimal(tmp_path):
    draw = random.Random(8)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 7))).encode() for _ in range(900)} | {"zß".encode()}
    table = {w: tuple(w) * 2 for w in words}
    bpe.Lexicon.build(table).save(str(tmp_path / "x"))
    lexicon = bpe.Lexicon.open(str(tmp_path / "x"))
    asked = sorted(words) + [b"", b"a" * 8, b"abcabcab", b"z", b"q", b"a" * 100]
    ranks = lexicon.ranks(asked).tolist()
    for w, r in zip(asked, ranks, strict=True):
        assert (r >= 0) == (w in words) and (r < 0 or lexicon.ids_of(r) == table[w])
    ends = {}  # one state for each different set of continuations
    for w in words:
        for i in range(len(w) + 1):
            ends.setdefault(w[:i], set()).add(w[i:])
    assert len(lexicon.final) == len({frozenset(x) for x in ends.values()})


def test_frequent_words_keep_within_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(500)] + [("y" * 60, 10_000)], "word string, n long")
    assert len(bpe.frequent_words(counts, 10_000)) == 500
    few = bpe.frequent_words(counts, 100)
    assert 0 < len(few) <= 100 and "w499" in few
    assert bpe.frequent_words(counts.limit(0), 10) == []


def test_a_lexicon_of_a_few_rows_gives_the_same_ids(spark, library, monkeypatch):
    texts = [t or "" for t in fixture()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bpe.sampled, "__defaults__", (20,))
    assert 0 < bpe.sampled(df).count() < 60
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df, "doc_id", PATH).collect()}
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), "doc_id", PATH).count() == 0


def test_the_lexicon_knows_the_words_of_all_rows(spark, monkeypatch):
    # one frequent word in the first 30,000 rows and another in a part a draw of 20,000 of them would thin out
    df = spark.range(0, 30_000, 1, 3).selectExpr("id AS doc_id", "if(id % 10000 = 7, 'rareword', 'often') AS text")
    counted, words = [], bpe.frequent_words
    monkeypatch.setattr(bpe, "frequent_words", lambda counts, most: (counted.append({r["word"]: r["n"] for r in counts.collect()}), words(counts, most))[1])
    assert bpe.encoded(df, "doc_id", PATH).count() == 30_000
    assert counted == [{"often": 29_997, "rareword": 3}]


def test_tokens_by_arrays_are_the_words_of_the_pattern(monkeypatch):
    merges = bpe.Merges(PATH)
    draw = random.Random(5)
    short = ["'", "'s", "'S", "'t", "'re", "'rE", "'r", "'ve", "'m", "'ll", "'l", "'d", "é", "e\u0301", "a", "s", "7", "½", "-", " ", "\n", "\x1c", "\u200b", "\u0345", "İ", "ΑΣ", "😀", "中", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["", *fixture()[1:], *["".join(draw.choice(short) for _ in range(draw.randint(1, 12))) for _ in range(5_000)], ""]
    monkeypatch.setattr(merges, "words", lambda text: 1 / 0)  # the arrays do not go through the pattern
    tokens, cuts = merges.tokens(texts)
    monkeypatch.undo()
    words = tokens.to_pylist()
    assert cuts[0] == 0 and cuts[-1] == len(words)
    for i, text in enumerate(texts):
        assert words[cuts[i] : cuts[i + 1]] == merges.words(text), repr(text)
    for texts in ([], ["", " "], ["plain text's", "3 a"]):
        tokens, cuts = merges.tokens(texts)
        assert tokens.to_pylist() == [w for x in texts for w in merges.words(x)] and len(cuts) == len(texts) + 1


def test_every_code_point_is_split_as_by_the_pattern():
    merges = bpe.Merges(PATH)
    text = " ".join(f"a{chr(c)}b{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [text[i : i + 600_000] for i in range(0, len(text), 600_000)]
    tokens, cuts = merges.tokens(texts)
    words = tokens.to_pylist()
    assert all(words[a:b] == merges.words(x) for a, b, x in zip(cuts, cuts[1:], texts))


def test_a_counting_task_holds_few_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED", 50)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    texts = [t for t in fixture()] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    merges = bpe.Merges(PATH)
    counts = {}
    for t in texts:
        for w in merges.words(t):
            counts[w] = counts.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in bpe.word_counts(df, PATH).collect()} == counts


def test_idle_workers_hold_no_words(spark):
    df = spark.range(0, 4_000, 1, 8).selectExpr("id AS doc_id", "concat('word', translate(id, '0123456789', 'abcdefghij'), ' again') AS text")
    assert bpe.encoded(df, "doc_id", PATH).count() == 4_000

    def held(batches):
        import time

        import pyarrow as pa

        from crosstide.llm import bpe

        time.sleep(0.3)  # so that all workers have a task
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, bpe.Encoder) for x in bpe._OPEN.values())]), pa.array([sum(len(x.number) for x in bpe._OPEN.values() if isinstance(x, bpe.Encoder))])], ["encoders", "words"])

    found = spark.range(0, 16, 1, 16).mapInArrow(held, "encoders long, words long").collect()
    assert sum(r["encoders"] for r in found) and not sum(r["words"] for r in found)
