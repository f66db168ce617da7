"""Operators on small panels, against pandas or plain numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.functions import basics as b
from crosstide.functions import rolling as ts
from crosstide.operators import checks, cross_section, ranking, smoothing
from crosstide.operators.smoothing import Ewm
from crosstide.sources import panel as panels

KEYS = ["instrument", "datetime"]


def values(df, name):
    pdf = df.toPandas().sort_values(KEYS)
    return pdf[name].astype("float64").to_numpy()


def per_instrument(hand_panel, fn):
    pdf = hand_panel.toPandas().sort_values(KEYS)
    parts = [fn(g["x"], g["y"]) for _, g in pdf.groupby("instrument")]
    return pd.concat(parts).to_numpy(float)


def weighted(window):
    ages = np.arange(len(window))[::-1]
    return (window * 0.9**ages).sum() / (0.9**ages).sum()


def decayed(p):
    return lambda window: (window * np.arange(1, len(window) + 1)).sum() / (p * (p + 1) / 2)


CASES = {
    "mean": (lambda: ts.mean("x", 4), lambda x, y: x.rolling(4, min_periods=1).mean()),
    "std": (lambda: ts.std("x", 4), lambda x, y: x.rolling(4, min_periods=1).std()),
    "median": (lambda: ts.median("x", 4), lambda x, y: x.rolling(4, min_periods=1).median()),
    "quantile": (lambda: ts.quantile("x", 4, 0.3), lambda x, y: x.rolling(4, min_periods=1).quantile(0.3)),
    "rank": (lambda: ts.rank("x", 4), lambda x, y: x.rolling(4, min_periods=1).rank(pct=True)),
    "wma": (lambda: ts.wma("x", 4), lambda x, y: x.rolling(4, min_periods=1).apply(weighted, raw=True)),
    "product": (lambda: ts.product("x", 3), lambda x, y: x.rolling(3, min_periods=1).apply(np.prod, raw=True)),
    "delta": (lambda: ts.delta("x", 2), lambda x, y: x.diff(2)),
    "pct": (lambda: ts.pct_change(F.abs("y") + 1, 2), lambda x, y: (y.abs() + 1).pct_change(2, fill_method=None).fillna(0)),
    "cov": (lambda: ts.covariance("x", "y", 5), lambda x, y: x.rolling(5, min_periods=2).cov(y)),
    "band": (lambda: ts.band_upper("x", 5), lambda x, y: x.rolling(5, min_periods=1).mean() + x.rolling(5, min_periods=1).std()),
    "beyond": (lambda: ts.total("x", 50), lambda x, y: x.rolling(50, min_periods=1).sum()),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rolling_matches_pandas(hand_panel, name):
    build, expected = CASES[name]
    got = values(hand_panel.withColumn("v", build()), "v")
    want = per_instrument(hand_panel, expected)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_decay_linear_short_windows_are_not_renormalised(hand_panel):
    got = values(hand_panel.withColumn("v", ts.decay_linear("y", 5)), "v")
    want = per_instrument(hand_panel, lambda x, y: y.rolling(5, min_periods=1).apply(decayed(5), raw=True))
    np.testing.assert_allclose(got, want)


def test_mad_and_extremes_skip_missing(hand_panel):
    df = hand_panel.where("instrument = 1").withColumns(
        {"mad": ts.mad("x", 4), "hi": ts.argmax("x", 4), "lo": ts.argmin("x", 4), "day": ts.highday("x", 4)}
    )
    x = hand_panel.where("instrument = 1").toPandas().sort_values(KEYS)["x"].to_list()
    rows = df.toPandas().sort_values(KEYS)
    for i in range(len(x)):
        seen = [(v, j) for j, v in list(enumerate(x))[max(0, i - 3): i + 1] if not np.isnan(v)]
        row = rows.iloc[i]
        if not seen:
            assert np.isnan(row.hi) and np.isnan(row["mad"])
            continue
        nums = [v for v, _ in seen]
        assert row["mad"] == pytest.approx(np.median(np.abs(np.array(nums) - np.median(nums))))
        assert row.hi == i - min(j for v, j in seen if v == max(nums))
        assert row.lo == i - min(j for v, j in seen if v == min(nums))
        assert row.day == row.hi + 1


def test_corr_of_a_constant_side(hand_panel):
    flat = hand_panel.where("instrument = 3")
    assert flat.withColumn("v", ts.corr("x", "y", 5)).where("v IS NOT NULL").count() == 0
    timed = values(flat.withColumn("v", ts.corr_time("x", 5)), "v")
    assert np.isnan(timed[0]) and (timed[1:] == 0).all()


def test_regression_needs_full_windows(hand_panel):
    got = values(hand_panel.where("instrument = 1").withColumn("v", ts.beta("x", "y", 5)), "v")
    pdf = hand_panel.where("instrument = 1").toPandas().sort_values(KEYS).fillna({"x": 0.0})
    assert np.isnan(got[:4]).all()
    for i in range(4, 12):
        win = pdf.iloc[i - 4: i + 1]
        assert got[i] == pytest.approx(np.polyfit(win["y"], win["x"], 1)[0])


def test_delay_refuses_to_look_ahead():
    with pytest.raises(ValueError):
        ts.delay("x", -1)


def test_varying_bands(hand_panel):
    mid, up, low = ts.varying_bands("x", F.col("y") + 1, 6)
    df = hand_panel.withColumns({"mid": mid, "up": up, "low": low}).toPandas().sort_values(KEYS)
    for _, g in df.groupby("instrument"):
        for i in range(len(g)):
            w = int(g["y"].iloc[i] + 1)
            win = g["x"].iloc[max(0, i - w + 1): i + 1]
            np.testing.assert_allclose(g["mid"].iloc[i], win.mean())
            np.testing.assert_allclose(g["up"].iloc[i], win.mean() + win.std())
    with pytest.raises(Exception, match="window length above"):
        m, _, _ = ts.varying_bands("x", F.lit(9), 6)
        hand_panel.select(m).collect()


def test_ewm_carries_over_gaps(hand_panel):
    df = smoothing.with_ewm(hand_panel, {"e": Ewm("x", span=4), "a": Ewm("x", alpha=0.3)})
    np.testing.assert_allclose(values(df, "e"), per_instrument(hand_panel, lambda x, y: x.ewm(span=4).mean()))
    np.testing.assert_allclose(values(df, "a"), per_instrument(hand_panel, lambda x, y: x.ewm(alpha=0.3).mean()))


def test_elementwise_edges(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (4.0, None), (float("nan"), 2.0)], "a double, b double")
    row = lambda c: [r[0] for r in df.select(c).collect()]
    assert row(b.div("a", "b"))[0] is None
    assert row(b.sqrt("a"))[:2] == [None, 2.0]
    assert row(b.log1p(F.col("b") - 1)) [0] is None
    assert row(b.larger("a", "b"))[1] is None
    assert row(b.ne("a", "b"))[1] is True and row(b.gt("a", "b"))[1] is False
    assert row(b.clean("a"))[2] is None and row(b.fill_zero("a"))[2] == 0.0
    assert row(b.where(F.col("b") > 1, "a", F.lit(9.0)))[1] == 9.0


def test_ranks_agree_with_and_without_hot_groups(spark):
    """One date holds most rows, one value holds a third of them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        day = pd.Timestamp("2020-01-01").date() if i % 10 else pd.Timestamp("2020-01-02").date()
        v = None if i % 13 == 0 else 7.0 if i % 3 == 0 else float(np.round(rng.lognormal(0, 3), 2))
        rows.append((day, i, v))
    df = spark.createDataFrame(rows, "datetime date, instrument long, x double")
    pdf = df.toPandas().sort_values("instrument")
    want = pdf.groupby("datetime")["x"].rank(pct=True).to_numpy()
    for hot in (10**9, 200):
        got = ranking.with_ranks(df, {"r": "x", "r2": "x"}, hot_rows=hot).toPandas().sort_values("instrument")
        np.testing.assert_allclose(got["r"].astype(float).to_numpy(), want)
        np.testing.assert_allclose(got["r2"].astype(float).to_numpy(), want)
        med = ranking.medians(df, "x", hot_rows=hot).toPandas().set_index("datetime")["median"]
        for day, m in pdf.groupby("datetime")["x"].median().items():
            assert med[day] == pytest.approx(m)


def test_single_row_date_has_rank_zero(spark):
    df = spark.sql("SELECT DATE'2020-01-01' AS datetime, 1L AS instrument, 5.0D AS x")
    assert cross_section.with_centred_ranks(df, {"r": "x"}).first().r == 0.0


def test_keep_last_and_slices(spark):
    df = spark.createDataFrame(
        [("2020-01-01", 1, 1, 5.0), ("2020-01-01", 1, 2, 6.0), ("2020-01-03", 1, 1, 7.0)],
        "datetime string, instrument long, version int, close double",
    ).withColumn("datetime", F.to_date("datetime"))
    kept = panels.keep_last(df, ["datetime", "instrument"], ["version"])
    assert sorted(r.close for r in kept.collect()) == [6.0, 7.0]
    assert panels.between(df, "2020-01-03", "2020-01-03").count() == 1


def test_minute_gaps(spark):
    times = ["10:00:00", "10:01:00", "10:01:30", "10:02:00", "10:03:00", "10:03:00"]
    df = spark.createDataFrame([(f"2020-01-01 {t}",) for t in times], "datetime string").withColumn(
        "datetime", F.to_timestamp("datetime")
    )
    assert checks.minute_gaps(df).first().minute_gaps == 2
