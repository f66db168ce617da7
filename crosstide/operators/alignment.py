"""Joins that bring factor tables, labels and date series onto one key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.lookups import lookup, with_row

KEYS = ("datetime", "instrument")


def with_label_only(features: DataFrame, label: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Features of the rows that have a label row."""
    return features.join(label, list(keys), "inner")


def merge_outer(tables: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Outer alignment of many factor tables with one shuffle.

    Keys are unique inside each table, so stacking the tables and taking the
    only non-missing value per key and column equals a chain of full outer
    joins.  A column name seen before is dropped from later tables.
    """
    seen: set[str] = set(keys)
    parts = []
    for table in tables:
        fresh = [c for c in table.columns if c not in seen]
        seen.update(fresh)
        parts.append(table.select(*keys, *fresh))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def align_to(
    reference: DataFrame, values: DataFrame, keys: Sequence[str] = KEYS, least: float = 0.5
) -> DataFrame:
    """Values on the reference's keys; no rows at all unless more than
    ``least`` of the reference finds a match."""
    joined = reference.select(*keys).join(values.withColumn("_hit", F.lit(1)), list(keys), "left")
    rate = joined.agg(F.avg(F.coalesce(F.col("_hit"), F.lit(0))).alias("_rate"))
    return with_row(joined, rate).where(F.col("_rate") > least).drop("_hit", "_rate")


def with_series(panel: DataFrame, series: DataFrame, value: str, name: str) -> DataFrame:
    """Bring a date series onto the panel, carrying the last value forward.

    The fill runs over the calendar alone (one row per DATE, hence the single
    unpartitioned window), and the filled calendar is broadcast; the panel is
    not shuffled.
    """
    calendar = (
        panel.select("datetime", F.lit(None).cast("double").alias("_v"))
        .unionByName(series.select("datetime", F.col(value).cast("double").alias("_v")))
        .groupBy("datetime")
        .agg(F.max("_v").alias("_v"))
    )
    filled = calendar.select(
        "datetime",
        F.last("_v", ignorenulls=True).over(Window.orderBy("datetime")).alias(name),
    )
    return panel.join(F.broadcast(filled), "datetime", "left")


def with_status(
    wanted: DataFrame, known: DataFrame, key: str, spread: Sequence[str], name: str = "cached"
) -> DataFrame:
    """Mark which wanted rows are already known; ``spread`` identifies a row."""
    hits = known.select(key).distinct().withColumn(name, F.lit(True))
    marked = lookup(wanted, hits, [key], spread)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def missing_from(wanted: DataFrame, known: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    return lookup(wanted, known.select(key).distinct(), [key], spread, "left_anti")


def compare_metrics(current: DataFrame, best: DataFrame, important: Sequence[str] = ()) -> DataFrame:
    """Current against best metric values, with the name of the larger column.

    Inputs are (metric, value).  A tie or a missing side counts for ``best``.
    """
    both = current.select("metric", F.col("value").alias("current")).join(
        best.select("metric", F.col("value").alias("best")), "metric", "full"
    )
    if important:
        both = both.where(F.col("metric").isin(list(important)))
    larger: Column = F.when(F.col("current") > F.col("best"), "current").otherwise("best")
    return both.withColumn("larger", larger)
