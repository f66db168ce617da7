"""Windows built from shorter windows against frames over all their rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.functions import ladder
from crosstide.functions import rolling as ts
from crosstide.functions.ladder import Ladder


@pytest.fixture(scope="module")
def climbed(spark):
    rng = random.Random(8)
    rows = []
    for i in range(70):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
        rows.append((day, 1, None if rng.random() < 0.2 else rng.random(), None if rng.random() < 0.2 else 1e6 + rng.random()))
        rows.append((day, 2, 0.1, rng.random()))  # a constant that sums inexactly
        rows.append((day, 3, None if i < 40 else float(i), float(i % 3)))
    df = spark.createDataFrame(rows, "datetime date, instrument long, x double, y double")
    spec = Ladder(sums=("x",), maxima=("x",), minima=("x",), moments=("x", "y"), pairs=(("x", "y"),), orders=("x", "y"))
    return ladder.climb(df, spec, [5, 10, 20, 30, 60]).cache()


@pytest.mark.parametrize("w", [5, 10, 20, 30, 60])
def test_every_value_matches_its_frame(climbed, w):
    pairs = {
        "total": (ladder.total("x", w), ts.total("x", w)),
        "hi": (ladder.maximum("x", w), ts.maximum("x", w)),
        "lo": (ladder.minimum("x", w), ts.minimum("x", w)),
        "mean": (ladder.mean("y", w), ts.mean("y", w)),
        "std_x": (ladder.std("x", w), ts.std("x", w)),
        "std_y": (ladder.std("y", w), ts.std("y", w)),
        "corr": (ladder.corr("x", "y", w), ts.corr("x", "y", w)),
        "median": (ladder.median("x", w), F.percentile("x", 0.5).over(ts.last_rows(w))),
        "high_quantile": (ladder.quantile("y", w, 0.8), F.percentile("y", 0.8).over(ts.last_rows(w))),
        "rank": (ladder.rank("y", w), ts.rank("y", w)),
        "rank_x": (ladder.rank("x", w), ts.rank("x", w)),
        "mad": (ladder.mad("x", w), ts.mad("x", w)),
    }
    got = climbed.select(
        "instrument", *[c.alias(f"{n}_{side}") for n, both in pairs.items() for side, c in zip("ab", both)]
    ).toPandas()
    for n in pairs:
        np.testing.assert_allclose(
            got[f"{n}_a"].astype(float), got[f"{n}_b"].astype(float), rtol=1e-7, atol=1e-9, err_msg=n
        )
    flat = got[got["instrument"] == 2]
    assert (flat["std_x_a"].dropna() == 0.0).all() and flat["corr_a"].isna().all()


def test_a_long_window_alone_brings_its_steps(spark, climbed):
    df = climbed.select("datetime", "instrument", "x", "y")
    out = ladder.climb(df, Ladder(sums=("x",)), [60]).where(F.col("instrument") == 1)
    assert {"_x_s5", "_x_s10", "_x_s30", "_x_s60"} <= set(out.columns) and "_x_s20" not in out.columns


def _frames(values, w):
    for i in range(len(values)):
        yield values[i], [v for v in values[max(0, i - w + 1): i + 1] if v is not None]


@pytest.mark.parametrize("w", [5, 7, 30])
def test_order_statistics_match_a_count_over_each_frame(spark, hand_panel, w):
    own = {"q": ts.quantile("x", w, 0.3), "r": ts.rank("x", w), "m": ts.mad("x", w)}
    merged = {"lq": ladder.quantile("x", w, 0.3), "lr": ladder.rank("x", w), "lm": ladder.mad("x", w)}
    out = ladder.climb(hand_panel, Ladder(orders=("x",)), [w])
    got = out.select("datetime", "instrument", "x", *[c.alias(n) for n, c in {**own, **merged}.items()]).toPandas()
    for _, rows in got.sort_values("datetime").groupby("instrument"):
        values = [None if np.isnan(v) else v for v in rows["x"].astype(float)]
        expected = []
        for now, seen in _frames(values, w):
            q = np.quantile(seen, 0.3) if seen else np.nan
            m = np.median(np.abs(np.array(seen) - np.median(seen))) if seen else np.nan
            below, ties = sum(v < now for v in seen) if now is not None else 0, seen.count(now)
            r = np.nan if now is None else (below + (ties + 1) / 2) / len(seen)
            expected.append((q, r, m))
        for names in (list(own), list(merged)):
            np.testing.assert_allclose(rows[names].astype(float).to_numpy(), np.array(expected, dtype=float), rtol=1e-9)


def test_ranks_see_large_integers_and_both_zeros(spark):
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(days=i), 1, v, z) for i, (v, z) in enumerate([(2**53, 0.0), (2**53 + 1, -0.0), (2**53, 0.0)])]
    df = spark.createDataFrame(rows, "datetime date, instrument long, v long, z double")
    got = df.select("datetime", ts.rank("v", 3).alias("v"), ts.rank("z", 3).alias("z")).orderBy("datetime").collect()
    assert [r["v"] for r in got] == [1.0, 1.0, 0.5] and [r["z"] for r in got] == [1.0, 0.75, 2 / 3]


@pytest.mark.parametrize("w", [15, 40, 120])
def test_further_windows_are_built_from_shorter_ones(climbed, w):
    df = climbed.select("datetime", "instrument", "x", "y")
    out = ladder.climb(df, Ladder(moments=("x",)), [w])
    assert f"_x_m{ladder.STEPS[w][0]}" in out.columns
    got = out.select(ladder.mean("x", w).alias("a"), ts.mean("x", w).alias("b"), ladder.std("x", w).alias("c"), ts.std("x", w).alias("d"))
    got = got.toPandas().astype(float)
    np.testing.assert_allclose(got["a"], got["b"], rtol=1e-9)
    np.testing.assert_allclose(got["c"], got["d"], rtol=1e-7, atol=1e-9)


def test_what_reads_one_window_leaves_nothing_of_it_to_carry(climbed):
    df = climbed.select("datetime", "instrument", "x", "y")
    rungs = {5: Ladder(sums=("x",), orders=("x",)), 60: Ladder(moments=("x",))}
    ready = {5: {"s": ladder.total("x", 5)}, 60: {"m": ladder.mean("x", 60)}, ladder.ORDERS: {"q": ladder.median("x", 5)}}
    out = ladder.climb_rungs(df, rungs, ready).select("instrument", "_f5.s", "_f60.m", "_f0.q")
    want = df.select("instrument", ts.total("x", 5).alias("s"), ts.mean("x", 60).alias("m"), ts.median("x", 5).alias("q"))
    assert out.count() == df.count()
    for name in ("s", "m", "q"):
        np.testing.assert_allclose(*[np.sort(d.toPandas()[name].astype(float)) for d in (out, want)], rtol=1e-7)
