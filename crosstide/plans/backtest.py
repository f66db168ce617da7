"""From scored rows to a daily report of a top-k portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import metrics
from crosstide.session import cut_lineage


def daily_report(
    scored: DataFrame,
    signal: str,
    ret: str,
    k: int = 50,
    open_cost: float = 0.0005,
    close_cost: float = 0.0015,
    scale: float = 1.0,
) -> DataFrame:
    """(datetime, port_ret, bench, cost, excess), one row per date.

    The holdings, at most k rows per date, feed returns and turnover; they are
    written down once, so the signal is not computed again for each use.  The
    benchmark is the mean return of all names.  ``scale`` multiplies returns.
    """
    chosen = metrics.top_holdings(scored, signal, k).select("datetime", "instrument", ret)
    held = cut_lineage(chosen)
    bench = scored.groupBy("datetime").agg((F.avg(ret) * scale).alias("bench"))
    daily = metrics.portfolio_return(held, ret).withColumn("port_ret", F.col("port_ret") * scale)
    cost = metrics.turnover_cost(held, open_cost, close_cost).select("datetime", "cost")
    return metrics.excess_return(daily.join(cost, "datetime").join(bench, "datetime"))
