"""Exact ranks and medians inside groups of any size.

A window partitioned by group sorts one group in one task.  That is the best
plan while groups are small, and the wrong one when a date holds a third of a
huge panel.  Group sizes are counted first; when one passes ``hot_rows`` the
rank is computed from value counts instead:

1. equal values collapse to one row with a count (combined before the shuffle),
2. each hot group is cut at approximate quantiles into ordered buckets,
3. running counts inside a bucket plus the totals of the buckets before it give
   the exact number of smaller values.

The cut points steer only the balance of the work; every count is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from crosstide.session import cut_lineage, shuffle_width

HOT_ROWS = 2_000_000
#: Rows of the largest group from which on groups are dealt over more tasks, one more session width for each so many rows, and how many widths at most.
DEAL_ROWS, MOST_WIDTHS = 5_000, 8
_NULL_SPREAD = 512


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add the row number (from 1) in a total order over the whole table.

    Rows are dealt by ranges of the order, numbered inside each, and moved on by
    the sizes of the ranges before (one small row per range on the driver).
    """
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    before, total = [], 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before.append((row["part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.withColumn(name, F.col("_before") + F.col("_place") % (1 << 33) + 1).drop("_place", "_part", "_before")


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group (one pruned, pre-aggregated pass)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def value_positions(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
) -> DataFrame:
    """(group, value, ties, below, total): exact order statistics per value.

    ``biggest`` is an upper bound of the group size when the caller knows one.
    """
    group = list(group)
    if biggest is None:
        biggest = largest_group(df, group)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    numeric = isinstance(df.schema[value].dataType, NumericType)
    if biggest > hot_rows and not numeric:
        # Other types have no quantiles to cut at; the ranges a sort deals them into serve as buckets.
        dealt = counts.repartitionByRange(max(shuffle_width(df.sparkSession), 2 * biggest // hot_rows + 2), *group, value)
        counts = cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))
    elif biggest > hot_rows:
        buckets = 2 * biggest // hot_rows + 2
        hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        grid = [i / buckets for i in range(1, buckets)]
        # one small row per hot group; written down so that a retried task
        # never sees other cut points than the first attempt did
        cuts = cut_lineage(
            df.join(F.broadcast(hot.select(*group)), group, "left_semi")
            .groupBy(*group)
            .agg(F.percentile_approx(value, grid, 20 * buckets).alias("_cuts"))
        )
        counts = (
            counts.join(F.broadcast(cuts), group, "left")
            .withColumn(
                "_bucket",
                F.coalesce(
                    F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)
                ),
            )
            .drop("_cuts")
        )
    else:
        counts = counts.withColumn("_bucket", F.lit(0))

    inside = Window.partitionBy(*group, "_bucket").orderBy(value)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("_inside", F.coalesce(F.sum("ties").over(before), F.lit(0)))
    across = Window.partitionBy(*group).orderBy("_bucket")
    totals = (
        counts.groupBy(*group, "_bucket")
        .agg(F.sum("ties").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*group)))
        .drop("_n")
    )
    return (
        running.join(totals, [*group, "_bucket"])
        .withColumn("below", F.col("_inside") + F.col("_before"))
        .select(*group, value, "ties", "below", "total")
    )


def _dealt(df: DataFrame, group: list[str], biggest: int) -> DataFrame:
    """``df`` with its groups dealt over so many tasks that few meet in one.

    Every column's sort takes memory for all rows of a task.  Left to sizes in
    bytes, which a few narrow columns keep low, many large groups share a task.
    """
    if biggest < DEAL_ROWS:
        return df
    return df.repartition(shuffle_width(df.sparkSession) * min(MOST_WIDTHS, biggest // DEAL_ROWS), *group)


def _windowed(df: DataFrame, group: list[str], names: dict[str, str], pct: bool) -> DataFrame:
    everyone = Window.partitionBy(*group)
    out: dict[str, Column] = {}
    for name, value in names.items():
        x = F.col(value)
        upto = everyone.orderBy(x.asc_nulls_last())
        # rank counts from the first tie, the running count ends at the last
        average = (F.rank().over(upto) + F.count(x).over(upto)) / 2
        if pct:
            average = average / F.count(x).over(everyone)
        out[name] = F.when(x.isNotNull(), average)
    return df.withColumns(out)


def _counted(
    df: DataFrame,
    keys: list[str],
    group: list[str],
    names: dict[str, str],
    pct: bool,
    hot_rows: int,
    biggest: int,
) -> DataFrame:
    kinds: dict[str, list[str]] = {}
    for n, v in names.items():  # values keep their type, so each type has its own long table
        kinds.setdefault(df.schema[v].dataType.simpleString(), []).append(n)
    for same in kinds.values():
        named = F.array(*[F.struct(F.lit(n).alias("_name"), F.col(names[n]).alias("_x")) for n in same])
        long = df.select(*keys, F.explode(named).alias("_s")).select(*keys, "_s._name", "_s._x")
        at = [*group, "_name", "_x"]
        rank = F.col("below") + (F.col("ties") + 1) / 2
        places = value_positions(long, [*group, "_name"], "_x", hot_rows, biggest)
        places = places.select(*at, (rank / F.col("total") if pct else rank).alias("_rank"), "ties")
        # A value that more than hot_rows rows share: one in hot_rows rows at most, so these can be sent.
        shared = places.where(F.col("ties") > hot_rows).select(*at, F.col("_rank").alias("_hot"))
        long = long.join(F.broadcast(shared), at, "left")
        # Rows that are missing or ranked already match nothing more; spreading keeps them off one task.
        done = F.col("_x").isNull() | F.col("_hot").isNotNull()
        spread = F.when(done, 1 + F.pmod(F.hash(*keys), F.lit(_NULL_SPREAD))).otherwise(0)
        rest = places.where(F.col("ties") <= hot_rows).select(*at, "_rank", F.lit(0).alias("_spread"))
        ranked = long.withColumn("_spread", spread).join(rest, [*at, "_spread"], "left")
        best = F.coalesce("_hot", "_rank")
        wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, best)).alias(n) for n in same])
        df = df.join(wide, keys, "left")
    return df


def with_ranks(
    df: DataFrame,
    names: dict[str, str],
    group: Sequence[str] = ("datetime",),
    keys: Sequence[str] = ("datetime", "instrument"),
    pct: bool = True,
    hot_rows: int = HOT_ROWS,
    biggest: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add average-tie ranks ``{new column: value column}`` inside each group.

    ``keys`` identify a row.  Missing values get no rank and count for none.
    ``biggest`` is an upper bound of the group size; callers that filter on
    computed values pass the bound of the unfiltered table, whose count needs
    no more than the key columns.  ``dealt`` tells that ranks of the same groups
    were added just before, so their rows are in place.
    """
    if biggest is None:
        biggest = largest_group(df, list(group))
    if biggest <= hot_rows:
        return _windowed(df if dealt else _dealt(df, list(group), biggest), list(group), names, pct)
    return _counted(df, list(keys), list(group), names, pct, hot_rows, biggest)


def medians(
    df: DataFrame,
    value: str,
    group: Sequence[str] = ("datetime",),
    name: str = "median",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(group, median): exact, without holding a group's values in one task."""
    places = value_positions(df, group, value, hot_rows)
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor((F.col("total") + 2) / 2)
    covers = lambda pos: (F.col("below") < pos) & (pos <= F.col("below") + F.col("ties"))
    return places.groupBy(*group).agg(
        (
            (F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2
        ).alias(name)
    )
