"""Exponential averages against pandas, across block borders."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import smoothing
from crosstide.operators.smoothing import Ewm

AVERAGES = {"a": Ewm("x", span=5), "b": Ewm("x", alpha=0.9), "c": Ewm("y", alpha=0.02), "last": Ewm("x", alpha=1.0), "same": Ewm("y", span=5)}


def history(seed, rows):
    draw = random.Random(seed)
    gap = False
    out = []
    for day in range(rows):
        gap = draw.random() < (0.9 if gap else 0.15)
        x = None if gap else draw.choice([draw.gauss(0, 1), draw.gauss(1e6, 1e3), 1e-9])
        y = float("nan") if draw.random() < 0.3 else draw.gauss(5, 2)
        out.append((seed, day, x, y))
    return out


@pytest.mark.parametrize("decades", [200.0, 3.0, 12.0])
def test_averages_equal_pandas(spark, monkeypatch, decades):
    monkeypatch.setattr(smoothing, "BLOCK_DECADES", decades)
    rows = [r for seed, n in ((1, 1), (2, 40), (3, 900), (4, 300)) for r in history(seed, n)] + [(9, day, None, None) for day in range(5)]
    df = spark.createDataFrame(rows, "instrument long, datetime long, x double, y double").repartition(5)
    got = smoothing.with_ewm(df, AVERAGES).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    assert list(got.columns) == ["instrument", "datetime", "x", "y", *AVERAGES]
    frame = pd.DataFrame(rows, columns=["instrument", "datetime", "x", "y"]).astype({"x": "float64"})
    for name, e in AVERAGES.items():
        want = frame.groupby("instrument")[e.value].transform(lambda s, e=e: s.ewm(alpha=e.decay(), min_periods=1).mean())
        # the carry of one block stands for all before it, exact to a weight of 10 ** -decades
        pd.testing.assert_series_equal(got[name], want, check_names=False, rtol=1e-9 if decades == 200.0 else 3 * 10 ** -decades * 1e6, atol=1e-9)


def test_no_shuffle_beyond_the_panels_own_and_no_python(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("instrument"), F.col("id").alias("datetime"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    dealt = df.repartition("instrument")
    plan = smoothing.with_ewm(dealt, AVERAGES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Pandas" not in plan and "Arrow" not in plan


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "instrument long, datetime long, x double, y double")
    assert smoothing.with_ewm(empty, AVERAGES).count() == 0
