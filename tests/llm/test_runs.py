"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.llm import catalog, runs


def brute(words, least=24, exponent=3):
    found, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        s = 0
        while s + q < len(words):
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(least, exponent * q) and (s, e + q) not in seen:
                seen.add((s, e + q))
                found.append((s, e + q, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(draw):
    words = []
    for _ in range(draw.randint(0, 6)):
        period = [draw.randint(0, draw.choice([1, 2, 50])) for _ in range(draw.randint(1, 30))]
        words += (period * 20)[: draw.randint(1, len(period) * 6)]
    return words


@pytest.mark.parametrize("least", [24, 1, 5, 40])
def test_catchers_equal_brute_force_however_words_arrive(least):
    draw = random.Random(least)
    for turn in range(400):
        words = random_words(draw)
        catchers, i = runs.Catchers(least), 0
        while i < len(words):
            step = draw.randint(1, 9) if turn % 2 else len(words)
            catchers.append(np.array(words[i : i + step], dtype=np.int64))
            i += step
        assert catchers.runs() == brute(words, least), words


def test_fibonacci_words_and_one_long_run():
    a, b = [0], [0, 1]
    while len(b) < 1200:
        a, b = b, b + a
    catchers = runs.Catchers()
    catchers.append(np.array(b))
    assert catchers.runs() == brute(b) != []
    catchers = runs.Catchers()
    catchers.append(np.zeros(300_000, dtype=np.int64))
    assert catchers.runs() == [(0, 300_000, 1)]


def test_two_periods_are_asked_for_in_vain():
    with pytest.raises(ValueError):
        runs.Catchers(exponent=2)


def test_operator_on_odd_rows(spark):
    draw = random.Random(5)
    texts = [None, "", " \n\t", "a " * 30, "a " * 23, "\x0b".join(["x", "é"] * 12), "a b c " * 20_000, "same " * 40, "same " * 40]
    texts += [" ".join(f"w{i}" for i in random_words(draw)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("runs", F.lit("x")).repartition(3)
    got = {r["doc_id"]: r for r in runs.repetitions(df, "doc_id").withColumn("best", runs.strongest()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        want = [(0, 60_000, 3)] if i == 6 else brute(words)
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == want
        dropped = {j for s, e, q in want for j in range(s + q, e)}
        assert got[i]["collapsed"] == " ".join(w.decode() for j, w in enumerate(words) if j not in dropped)
        top = min(want, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        best = got[i]["best"]
        assert (None if best is None else (best["start"], best["start"] + best["length"], best["period"])) == top
    assert runs.repetitions(df.limit(0), "doc_id").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and any(r["n_runs"] for r in got.values())
    for d in docs:
        words = (d["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # brute force is quadratic
        want, r = brute(words), got[d["doc_id"]]
        dropped = {j for s, e, q in want for j in range(s + q, e)}
        top = min(want, key=lambda x: (-Fraction(x[1] - x[0], x[2]), x[0], x[2]), default=None)
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"]) == ((None,) * 3 if top is None else (top[0], top[1] - top[0], top[2]))
        assert r["exponent_milli"] == (None if top is None else 1000 * (top[1] - top[0]) // top[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in dropped)).hexdigest()
