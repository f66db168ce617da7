"""The backtest's prepared table is written down before the fit reads it again and again."""

from pyspark.sql import functions as F

from crosstide.catalog.common import panel
from crosstide.plans import feature_sets, trial


def test_the_fit_reads_ranks_that_are_written_already(spark, monkeypatch):
    seen = []

    def fit(ready, names, label):
        seen.append(ready._jdf.queryExecution().executedPlan().toString())
        return ready.where("segment = 'test'").select("datetime", "instrument", F.lit(0.0).alias("score"))

    monkeypatch.setattr(trial.modelling, "boosted_signal", fit)
    segments = {"train": ("1995-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
    scored = trial.signal(panel(spark, "/root/testdata/sf0.001"), feature_sets.baseline_4(), segments)
    assert "Window" not in seen[0] and "ExistingRDD" in seen[0]
    assert scored.count() > 0
