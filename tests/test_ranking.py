"""Ranks of values that are no numbers, in groups too large for one window."""

import random

import pytest
from pyspark.sql import functions as F

from crosstide.operators import ranking


@pytest.mark.parametrize("kind", ["string", "date"])
def test_hot_groups_of_other_types(spark, kind):
    draw = random.Random(6)
    rows = [(i % 20 and 1, i, draw.choice([None, *"abcdefgh"]) if i % 3 else f"z{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "datetime int, instrument int, v string").repartition(5)
    if kind == "date":
        df = df.withColumn("v", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.crc32("v"), F.lit(300)).cast("int")))
    plain = ranking.with_ranks(df, {"rank": "v"}, pct=False)
    hot = ranking.with_ranks(df, {"rank": "v"}, pct=False, hot_rows=50)
    assert sorted(map(str, hot.select("datetime", "instrument", "rank").collect())) == sorted(map(str, plain.select("datetime", "instrument", "rank").collect()))
    places = ranking.value_positions(df, ["datetime"], "v", hot_rows=50)
    widest = places.groupBy("datetime").agg(F.sum("ties").alias("n"), F.max(F.col("below") + F.col("ties")).alias("end"), F.max("total").alias("total"))
    assert all(r.n == r.end == r.total for r in widest.collect())


def test_large_groups_do_not_share_a_task(spark, monkeypatch):
    # 24 dates of 1,500 narrow rows: by their bytes all would be folded into one or two tasks
    df = spark.range(36_000).selectExpr("CAST(id % 24 AS INT) AS datetime", "id AS instrument", "CAST(id * 7919 % 1009 AS DOUBLE) AS v")
    plain = ranking.with_ranks(df, {"rank": "v"})
    monkeypatch.setattr(ranking, "DEAL_ROWS", 100, raising=False)
    got = ranking.with_ranks(df, {"rank": "v"}).withColumn("task", F.spark_partition_id())
    dates = got.groupBy("task").agg(F.count_distinct("datetime").alias("n")).collect()
    assert max(r.n for r in dates) <= 4 and len(dates) >= 12
    assert got.drop("task").exceptAll(plain).count() == 0 and got.count() == 36_000
