"""The whole chain of a backtest: factors, label, prepared table, fitted signal, coefficients, portfolio, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import metrics, modelling
from crosstide.operators.lookups import with_row
from crosstide.plans import backtest, dataset, feature_sets
from crosstide.session import cut_lineage
from crosstide.sources import panel as panels


def signal(
    panel: DataFrame, factors: feature_sets.FactorSet, segments: dict[str, tuple[str, str]]
) -> DataFrame:
    """(datetime, instrument, score, label) on the test segment.

    Fitted on ranks of the train segment, stopped early on valid; the label
    given back is the plain forward return.  The factor matrix is written once,
    and so are its ranks, which the fit and the scores read five times.
    """
    names = list(factors.factors)
    matrix = cut_lineage(
        feature_sets.factor_matrix(panel.withColumn("label", feature_sets.label()), factors, ["label"])
    )
    ready = cut_lineage(panels.with_segment(dataset.prepare(matrix, names, "label"), segments))
    scores = modelling.boosted_signal(ready, names, "label")
    return scores.join(matrix.select("datetime", "instrument", "label"), ["datetime", "instrument"])


def daily(scored: DataFrame, k: int = 50, scale: float = 1.0) -> DataFrame:
    """One row per date: coefficients, holdings, cost, excess return."""
    scored = cut_lineage(scored)
    report = backtest.daily_report(scored, "score", "label", k, scale=scale)
    ic = metrics.daily_ic(scored, "score", "label")
    rank_ic = metrics.daily_rank_ic(scored, "score", "label")
    rows = scored.groupBy("datetime").agg(F.count(F.lit(1)).alias("rows"))
    return report.join(rows, "datetime").join(ic, "datetime", "left").join(rank_ic, "datetime", "left")


def summary(days: DataFrame) -> DataFrame:
    """One row: mean coefficients and their ratios, risk figures."""
    days = cut_lineage(days)
    return with_row(metrics.ic_summary(days, ["ic", "rank_ic"]), metrics.risk_metrics(days))
