"""Panel sources: build, clean, slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions import rolling
from crosstide.functions.basics import clean, div
from crosstide.session import shuffle_width

FIELDS = ("open", "high", "low", "close", "volume", "vwap")


def by_instrument(panel: DataFrame) -> DataFrame:
    """Partition once by instrument, so every later history window finds its
    rows in place.

    The partition count is the session's shuffle setting and is given outright:
    rolling sets are heavy per row, and size-based coalescing would fold a
    narrow panel into a few long tasks.
    """
    return panel.repartition(shuffle_width(panel.sparkSession), "instrument")


def with_return(panel: DataFrame) -> DataFrame:
    """Add ``ret``, the change of close against the instrument's previous row."""
    return panel.withColumn("ret", div("close", rolling.delay("close", 1)) - 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last in ``order``; pre-aggregated, so a key with
    very many copies is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return latest.select(*keys, "_row.*").select(*df.columns)


def load_panel(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    fields: Sequence[str] = FIELDS,
    universe: DataFrame | None = None,
    newest_by: Sequence[str] = (),
) -> DataFrame:
    """Read a stored panel: columns and dates reach the scan, the universe
    filter is a semi join, non-finite values become NULL.

    ``newest_by`` names the columns that order copies of a key; the last copy
    stays.  Leave it out for a store whose keys are unique already.
    """
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end).cast("date"))
    if universe is not None:
        df = df.join(universe.select("instrument"), "instrument", "left_semi")
    if newest_by:
        df = df.withColumn("datetime", F.col("datetime").cast("date"))
        df = keep_last(
            df.select("datetime", "instrument", *fields, *[c for c in newest_by if c not in fields]),
            ["datetime", "instrument"],
            newest_by,
        )
    return df.select(
        F.col("datetime").cast("date").alias("datetime"),
        "instrument",
        *[clean(F.col(f).cast("double")).alias(f) for f in fields],
    )


def debug_panel(panel: DataFrame, instruments: int = 100) -> DataFrame:
    """The first instruments by name, whole histories."""
    chosen = panel.select("instrument").distinct().orderBy("instrument").limit(instruments)
    return panel.join(F.broadcast(chosen), "instrument", "left_semi")


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a date range, both ends included."""
    return df.where(F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def with_segment(df: DataFrame, segments: dict[str, tuple[str, str]], name: str = "segment") -> DataFrame:
    """Label rows by named date ranges (train, valid, test)."""
    label = None
    for segment, (start, end) in segments.items():
        inside = F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        label = F.when(inside, segment) if label is None else label.when(inside, segment)
    return df.withColumn(name, label)


def weekly_panel(lineitem: DataFrame, at_once: bool = False) -> DataFrame:
    """Weekly bars per supplier from order lines.

    Price is extended price over quantity; the first and last trade of a week
    are ordered by date, order, line and price, which is a unique order.

    Lines are added up before they are shuffled, so a supplier with most of
    the lines does no harm.  ``at_once`` partitions the lines themselves by
    instrument, once for bars and histories: half of the bytes to disk and one
    sort, but all lines of a supplier pass through one task.
    """
    used = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    lines = lineitem.select(F.col("l_suppkey").alias("instrument"), *used)
    px = div("l_extendedprice", "l_quantity")
    when = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    trades = (by_instrument(lines) if at_once else lines).select(
        week.alias("datetime"),
        "instrument",
        px.alias("px"),
        when.alias("at"),
        "l_quantity",
        "l_extendedprice",
    )
    # history windows find the rows of an aggregate by instrument, then date in their order
    bars = trades.groupBy(*(("instrument", "datetime") if at_once else ("datetime", "instrument"))).agg(
        F.min_by("px", "at").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        div(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("vwap"),
    )
    return bars.select("datetime", "instrument", *FIELDS)
