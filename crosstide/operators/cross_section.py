"""Cross-sectional operators: one date, all instruments.

Everything that is an aggregate is computed as one: partial sums per task, one
row per date after the shuffle, broadcast back to the panel.  The panel itself
is never shuffled by date, so a date that holds a third of all rows costs no
more than any other.  The broadcast side has one row per DATE value, at most
366 a year whatever the panel's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import clean, col, div
from crosstide.operators import ranking


def with_date_stats(df: DataFrame, stats: dict[str, Column], date: str = "datetime") -> DataFrame:
    """Add per-date aggregates ``{new column: aggregate}`` to every row."""
    table = df.groupBy(date).agg(*[agg.alias(name) for name, agg in stats.items()])
    return df.join(F.broadcast(table), date, "left")


def _after(df: DataFrame, stats: dict[str, Column], name: str, value: Column) -> DataFrame:
    return with_date_stats(df, stats).withColumn(name, value).drop(*stats)


def with_mean(df: DataFrame, name: str, x: str) -> DataFrame:
    return with_date_stats(df, {name: F.avg(x)})


def with_std(df: DataFrame, name: str, x: str) -> DataFrame:
    return with_date_stats(df, {name: F.stddev_samp(x)})


def with_max(df: DataFrame, name: str, x: str) -> DataFrame:
    return with_date_stats(df, {name: F.max(x)})


def with_min(df: DataFrame, name: str, x: str) -> DataFrame:
    return with_date_stats(df, {name: F.min(x)})


def with_skew(df: DataFrame, name: str, x: str) -> DataFrame:
    """Population skewness on dates with three values or more."""
    return with_date_stats(df, {name: F.when(F.count(x) >= 3, clean(F.skewness(x)))})


def with_kurt(df: DataFrame, name: str, x: str) -> DataFrame:
    """Population excess kurtosis on dates with four values or more."""
    return with_date_stats(df, {name: F.when(F.count(x) >= 4, clean(F.kurtosis(x)))})


def with_median(df: DataFrame, name: str, x: str, hot_rows: int = ranking.HOT_ROWS) -> DataFrame:
    table = ranking.medians(df, x, name=name, hot_rows=hot_rows)
    return df.join(F.broadcast(table), "datetime", "left")


def with_zscore(df: DataFrame, name: str, x: str) -> DataFrame:
    value = div(F.col(x) - F.col("_mean"), F.col("_std"))
    return _after(df, {"_mean": F.avg(x), "_std": F.stddev_samp(x)}, name, value)


def with_scale(df: DataFrame, name: str, x: str, target: float = 1.0) -> DataFrame:
    """Rescale so that absolute values of a date sum to ``target``."""
    value = div(F.col(x) * target, F.col("_sum"))
    return _after(df, {"_sum": F.sum(F.abs(x))}, name, value)


def with_filled_mean(df: DataFrame, name: str, x: str) -> DataFrame:
    """Missing values take the date's mean, or zero on an empty date."""
    return _after(df, {"_mean": F.avg(x)}, name, F.coalesce(F.col(x), F.col("_mean"), F.lit(0.0)))


def with_rank(df: DataFrame, name: str, x: str, hot_rows: int = ranking.HOT_ROWS) -> DataFrame:
    return ranking.with_ranks(df, {name: x}, hot_rows=hot_rows)


def with_centred_ranks(
    df: DataFrame,
    names: dict[str, str],
    hot_rows: int = ranking.HOT_ROWS,
    biggest: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Percent rank minus one half; zero where a date has a single row.  ``dealt`` as in ``with_ranks``."""
    counted = with_date_stats(df, {"_rows": F.count(F.lit(1))})
    ranked = ranking.with_ranks(counted, names, hot_rows=hot_rows, biggest=biggest, dealt=dealt)
    return ranked.withColumns(
        {n: F.when(F.col("_rows") == 1, F.lit(0.0)).otherwise(F.col(n) - 0.5) for n in names}
    ).drop("_rows")


def with_rank_difference(
    df: DataFrame, name: str, x: str, y: str, hot_rows: int = ranking.HOT_ROWS
) -> DataFrame:
    ranked = ranking.with_ranks(df, {"_rx": x, "_ry": y}, pct=False, hot_rows=hot_rows)
    return ranked.withColumn(name, F.col("_rx") - F.col("_ry")).drop("_rx", "_ry")


def with_neutralised(df: DataFrame, name: str, x: str, size: str) -> DataFrame:
    """Residual of one pooled regression on ``size``, z-scored per date.

    Missing values take their date's mean, so they add nothing to a date's
    centred sums.  One pass takes each date's count, means and centred sums;
    the pooled line and every date's residual deviation follow from that table
    (one row per DATE), and a second pass applies them.
    """
    a, b = F.col(x).cast("double"), F.col(size).cast("double")
    pa, pb = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    mean = lambda v: F.coalesce(F.avg(v), F.lit(0.0))
    moment = lambda v: F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0))
    between = both * (F.avg(pa) - mean(a)) * (F.avg(pb) - mean(b))
    dates = df.groupBy("datetime").agg(
        F.count(F.lit(1)).alias("_n"), mean(a).alias("_mx"), mean(b).alias("_ms"),
        moment(a).alias("_qx"), moment(b).alias("_qs"),
        F.coalesce(F.covar_pop(pa, pb) * both + between, F.lit(0.0)).alias("_qxs"),
    )
    every = Window.partitionBy()  # over the calendar: one row per date
    centre = lambda m: F.sum(F.col("_n") * F.col(m)).over(every) / F.sum("_n").over(every)
    dates = dates.withColumns({"_cx": F.col("_mx") - centre("_mx"), "_cs": F.col("_ms") - centre("_ms")})
    across = F.sum(F.col("_qxs") + F.col("_n") * F.col("_cx") * F.col("_cs")).over(every)
    spread = F.sum(F.col("_qs") + F.col("_n") * F.col("_cs") * F.col("_cs")).over(every)
    dates = dates.withColumn("_b", div(across, spread))
    left = F.col("_qx") - 2 * F.col("_b") * F.col("_qxs") + F.col("_b") * F.col("_b") * F.col("_qs")
    dates = dates.withColumn("_std", F.sqrt(div(F.greatest(left, F.lit(0.0)), F.col("_n") - 1)))
    joined = df.join(F.broadcast(dates.select("datetime", "_mx", "_ms", "_b", "_std")), "datetime", "left")
    away = F.coalesce(a - F.col("_mx"), F.lit(0.0)) - F.col("_b") * F.coalesce(b - F.col("_ms"), F.lit(0.0))
    return joined.withColumn(name, div(away, F.col("_std"))).drop("_mx", "_ms", "_b", "_std")
