"""Overlap of many factors by one matrix product per date."""

import numpy as np
import pytest

from crosstide.operators import metrics


def brute(values, days, new, kept):
    out = []
    for i in range(new):
        means = []
        for j in range(new, new + kept):
            daily = []
            for day in np.unique(days):
                x, y = values[days == day][:, [i, j]].T
                both = np.isfinite(x) & np.isfinite(y)
                x, y = x[both], y[both]
                if len(x) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0:
                    daily.append(np.corrcoef(x, y)[0, 1])
            if daily:
                means.append(np.mean(daily))
        out.append(max(means, default=None))
    return out


@pytest.mark.parametrize("part_rows", [20_000, 15])
def test_overlap_equals_brute_force(spark, part_rows):
    rng = np.random.default_rng(4)
    new, kept, rows = 7, 9, 500
    values = rng.normal(size=(rows, new + kept)) * np.logspace(-3, 3, new + kept) + np.logspace(4, -2, new + kept)
    values[:, 2] = values[:, 9] * 3 - 1
    values[:, 4] = 5.1
    values[:, 5] = np.nan
    values[:, 0] += 0.5 * values[:, 8]
    values[rng.random(values.shape) < 0.1] = np.nan
    days = np.concatenate([np.arange(rows - 1) % 7 % 5, [77]])
    names = [f"f{i}" for i in range(new + kept)]
    data = [(int(d), i, *[None if np.isnan(v) else float(v) for v in row]) for i, (d, row) in enumerate(zip(days, values, strict=True))]
    df = spark.createDataFrame(data, "datetime int, instrument int, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    got = {r.factor: r.max_corr for r in metrics.overlap_with_kept(df, names[new:], names[:new], part_rows).collect()}
    want = dict(zip(names[:new], brute(values, days, new, kept), strict=True))
    assert got.keys() == want.keys() and got["f4"] is None and got["f5"] is None and got["f2"] > 0.999999
    for name, value in want.items():
        assert value is None and got[name] is None or abs(got[name] - value) < 1e-9, name


def test_the_plan_does_not_grow_with_factors(spark):
    names = [f"f{i}" for i in range(120)]
    df = spark.createDataFrame([(d, i, *[float((i * 7 + d + k) % 13) for k in range(120)]) for d in range(3) for i in range(20)], "datetime int, instrument int, " + ", ".join(f"{n} double" for n in names))
    out = metrics.overlap_with_kept(df, names[:60], names[60:])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert out.count() == 60
    assert metrics.overlap_with_kept(df.limit(0), names[:2], names[2:4]).where("max_corr IS NOT NULL").count() == 0
