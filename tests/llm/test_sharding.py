"""Rendezvous sharding against a plain-Python version."""

import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from crosstide.llm import sharding


def slow_shard(key, weights):
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(f"{'' if key is None else key}#{shard}".encode(), 42)
        score = (-weight / math.log(((h >> 12) + 0.5) * 2.0**-52), shard)
        best = max(best, score) if best else score
    return best[1]


TEXTS = ["a", "", None, "ж" * 30_000, "a", "tie"]


def test_shard_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 50)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(600)] + [(7, "a")] * 1_000 + [(None, "n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(99)).withColumn("size", F.lit("x")).withColumn("bucket_", F.lit(0)).repartition(7)
    out = sharding.shard_table(df, "doc_id", "text", 24).collect()
    assert len(out) == len(rows)
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), slow_shard(k, [1.0] * 24), slow_shard(k, [1.0] * 25)) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == want
    for shard in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" for r in out)


def test_weights_and_growth(spark):
    df = spark.range(20_000)
    old, new = [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]
    out = sharding.assigned(df, "id", old, new)
    n = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    moved = out.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and abs(moved.count() / 20_000 - 0.5) < 0.02


def test_empty_table(spark):
    assert sharding.shard_table(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 24).count() == 0
