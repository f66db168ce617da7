"""Formula texts against the same factors written as Columns."""

import math

import pytest
from pyspark.sql import functions as F

from crosstide.functions import basics
from crosstide.functions import rolling as ts
from crosstide.operators import cross_section, formulas, smoothing
from crosstide.session import scratch_path
from crosstide.sources import stores


def column(df, name):
    """The column's values by key."""
    return {(r["datetime"], r["instrument"]): r[name] for r in df.select("datetime", "instrument", name).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key in a:
        if a[key] is None or b[key] is None:
            assert a[key] is None and b[key] is None, key
        else:
            assert math.isclose(a[key], b[key], rel_tol=1e-9, abs_tol=1e-12), key


COLUMNS = {
    "TS_MEAN($x, 3)": lambda: ts.mean("x", 3),
    "TS_MEDIAN($x)": lambda: ts.median("x"),
    "TS_QUANTILE($x, 0.8, 4)": lambda: ts.quantile("x", 4, 0.8),
    "PERCENTILE($x, 0.25)": lambda: ts.percentile("x", 0.25),
    "TS_CORR($x, $y, 4)": lambda: ts.corr("x", "y", 4),
    "TS_CORR($y, SEQUENCE(4))": lambda: ts.corr_time("y", 4),
    "REGBETA($x, SEQUENCE(3), 3)": lambda: ts.beta("x", None, 3),
    "SUMIF($x, 4, $y > 1)": lambda: ts.sum_if("x", 4, basics.gt("y", 1)),
    "FILTER($x, $y > 1 & $x < 6)": lambda: basics.keep_if("x", basics.gt("y", 1) & basics.lt("x", 6)),
    "!($y > 1) ? $x : ($y == 0 ? 1 : -$x)": lambda: basics.where(
        ~basics.gt("y", 1), "x", basics.where(basics.eq("y", 0), 1.0, -F.col("x"))
    ),
    "MAX($x, $y, 2) * MIN($x, $y)": lambda: basics.larger("x", "y", 2) * basics.smaller("x", "y"),
    "$x / $y": lambda: basics.div("x", "y"),
    "$x * NAN": lambda: F.lit(None).cast("double"),
    "BB_UPPER($x, 4)": lambda: ts.band_upper("x", 4),
    "+$x - -2": lambda: F.col("x") + 2,
}


def test_texts_match_columns(spark, hand_panel):
    names = {f"v{i}": text for i, text in enumerate(COLUMNS)}
    out = formulas.with_values(hand_panel, names).cache()
    plain = hand_panel.select("datetime", "instrument", "x", "y", *[COLUMNS[t]().cast("double").alias(n) for n, t in names.items()])
    for name in names:
        same(column(out, name), column(plain, name))
    assert out.columns == [*hand_panel.columns, *names]


def test_calls_inside_calls(spark, hand_panel):
    out = formulas.with_values(
        hand_panel,
        {"a": "RANK(TS_MEAN($x, 3)) - RANK($y)", "b": "DELTA(ZSCORE(TS_MEAN($x, 3)), 1)", "c": "EMA($x, 3) + MAX($y)", "d": "SMA($x, 4, 1)"},
    )
    base = hand_panel.withColumn("m", ts.mean("x", 3))
    ranks = cross_section.with_rank(cross_section.with_rank(base, "rm", "m"), "ry", "y").withColumn("a", F.col("rm") - F.col("ry"))
    same(column(out, "a"), column(ranks, "a"))
    same(column(out, "b"), column(cross_section.with_zscore(base, "z", "m").withColumn("b", ts.delta("z", 1)), "b"))
    smooth = cross_section.with_max(smoothing.with_ema(hand_panel, "e", "x", 3), "t", "y").withColumn("c", F.col("e") + F.col("t"))
    same(column(out, "c"), column(smooth, "c"))
    same(column(out, "d"), column(smoothing.with_ewm(hand_panel, {"d": smoothing.Ewm("x", alpha=0.25)}), "d"))


def test_shared_calls_are_computed_once_and_share_the_exchange(spark, hand_panel):
    out = formulas.with_values(hand_panel.repartition(4), {"a": "TS_MEAN($x, 7) + 1", "b": "TS_MEAN($x, 7) / TS_STD($x, 7)", "c": "DELTA(TS_MEAN($x, 7))"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert physical.count("hashpartitioning(instrument") == 1


def test_own_functions_fields_and_clashing_names(spark, hand_panel):
    df = hand_panel.withColumnRenamed("x", "ret").withColumn("_f0", F.lit("kept"))
    out = formulas.with_values(df, {"v": "TWICE($return) + TS_SUM($size, 2)"}, {"size": "y"}, {"TWICE": lambda x: x * 2})
    same(column(out, "v"), column(df.withColumn("v", F.col("ret") * 2 + ts.total("y", 2)), "v"))
    assert {r["_f0"] for r in out.collect()} == {"kept"}
    assert formulas.with_values(df.limit(0), {"v": "RANK(TS_MEAN($return, 3))"}).count() == 0


@pytest.mark.parametrize("text", [
    "", "TS_MEAN($x, ", "NOPE($x)", "$missing + 1", "DELAY($x, -1)", "TS_MEAN($x, 0)", "RANK($x, 2)", "$x.real", "__import__('os')",
    "TS_MEAN($x, 1, 2, 3)", "EMA($x, $y)", "$x % 2", "$x ? 1", "[1, 2]", "'text'", "REGBETA(SEQUENCE(3), $x, 3)",
])
def test_texts_that_are_no_formula(hand_panel, text):
    with pytest.raises(ValueError):
        formulas.with_values(hand_panel, {"v": text})


def test_a_store_is_filled_from_texts(spark, hand_panel):
    path = scratch_path(spark, "formula_values")
    texts = ["TS_MEAN($x, 3)", "RANK($y)", "TS_MEAN($x, 3)", "$x - $y"]
    assert sorted(formulas.fill_store(hand_panel, texts, path, batch=2)) == sorted(set(texts))
    assert formulas.fill_store(hand_panel, [*texts, "$y"], path) == ["$y"]
    stored = stores.read_store(spark, path, ["RANK($y)"]).withColumnRenamed("value", "v")
    same(column(stored, "v"), column(cross_section.with_rank(hand_panel, "v", "y"), "v"))
