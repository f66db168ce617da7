"""Quality checks between two tables (datetime, instrument, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import INF, div
from crosstide.operators import metrics, ranking
from crosstide.operators.lookups import with_row
from crosstide.session import cut_lineage

KEYS = ["datetime", "instrument"]


def infinite_count(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.count_if(F.abs(F.col(value)) == INF).alias("infinite"))


def single_value_column(df: DataFrame, keys: Sequence[str] = KEYS) -> bool:
    """Whether the schema holds exactly one column besides the keys."""
    return len([c for c in df.columns if c not in keys]) == 1


def minute_gaps(df: DataFrame, time: str = "datetime") -> DataFrame:
    """How often consecutive distinct times lie exactly one minute apart.

    Instead of ordering all times in one task, each minute is ordered on its
    own with a copy of the minute before it: a predecessor 60 s away can only
    be there.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    minute = 60 * 1_000_000
    slots = df.where(F.col(time).isNotNull()).select(micros.alias("_t")).distinct()
    home = F.floor(F.col("_t") / minute)
    pieces = slots.select(
        "_t", F.explode(F.array(home, home + 1)).alias("_m")
    ).withColumn("_own", F.col("_m") == home)
    ordered = Window.partitionBy("_m").orderBy("_t")
    steps = pieces.withColumn("_step", F.col("_t") - F.lag("_t").over(ordered))
    return steps.where("_own").agg(F.count_if(F.col("_step") == minute).alias("minute_gaps"))


def row_count_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    counts = with_row(a.agg(F.count(F.lit(1)).alias("_a")), b.agg(F.count(F.lit(1)).alias("_b")))
    return counts.select(
        div(F.least("_a", "_b").cast("double"), F.greatest("_a", "_b").cast("double")).alias("ratio")
    )


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer alignment with presence flags; the base of most checks."""
    left = a.select(*KEYS, F.col("value").alias("va"), F.lit(True).alias("in_a"))
    right = b.select(*KEYS, F.col("value").alias("vb"), F.lit(True).alias("in_b"))
    return left.join(right, KEYS, "full")


def _equal(tolerance: float):
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return both & (F.abs(F.col("va") - F.col("vb")) < tolerance)


def comparison(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row of facts from a single alignment: key overlap, missing counts,
    share of equal values (a key of one side only is unequal), row-count ratio."""
    return _facts(aligned(a, b), tolerance)


def _facts(pair: DataFrame, tolerance: float) -> DataFrame:
    count = lambda c: F.count_if(c).cast("double")
    rows_a, rows_b = count(F.col("in_a")), count(F.col("in_b"))
    missing_a = F.count_if(F.col("in_a") & F.col("va").isNull())
    missing_b = F.count_if(F.col("in_b") & F.col("vb").isNull())
    return pair.agg(
        div(count(F.col("in_a") & F.col("in_b")), F.count(F.lit(1))).alias("jaccard"),
        missing_a.alias("missing_a"),
        missing_b.alias("missing_b"),
        (missing_a == missing_b).alias("same"),
        div(count(_equal(tolerance)), F.count(F.lit(1))).alias("equal_ratio"),
        div(F.least(rows_a, rows_b), F.greatest(rows_a, rows_b)).alias("ratio"),
    )


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard similarity of the key sets."""
    return comparison(a, b).select("jaccard")


def missing_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return comparison(a, b).select("missing_a", "missing_b", "same")


def equal_ratio(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Share of keys whose values agree."""
    return comparison(a, b, tolerance).select("equal_ratio")


def agreement(a: DataFrame, b: DataFrame, hot_rows: int = ranking.HOT_ROWS) -> DataFrame:
    """Mean daily correlation and rank correlation between the two tables."""
    return _agreement(aligned(a, b), ranking.largest_group(a, ["datetime"]), hot_rows)


def _agreement(pair: DataFrame, biggest: int, hot_rows: int = ranking.HOT_ROWS) -> DataFrame:
    both = pair.where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    ranked = ranking.with_ranks(
        both, {"_ra": "va", "_rb": "vb"}, pct=False, hot_rows=hot_rows, biggest=biggest
    )
    daily = ranked.groupBy("datetime").agg(
        metrics.pearson("va", "vb").alias("ic"), metrics.pearson("_ra", "_rb").alias("rank_ic")
    )
    return daily.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic")).withColumn(
        "passed", F.coalesce((F.col("ic") > 0.99) & (F.col("rank_ic") > 0.99), F.lit(False))
    )


def verdict(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row with the combined decision on table ``a`` against truth ``b``.

    'true' when values agree, or keys overlap and both correlations pass;
    'false' when row counts, missing counts, grain or finiteness fail;
    'undecided' otherwise.  The tables are aligned once, and all facts are
    taken from the written alignment.
    """
    pair = cut_lineage(aligned(a, b))
    own = pair.where("in_a")
    agreed = _agreement(pair, ranking.largest_group(own, ["datetime"])).select("passed")
    facts = _facts(pair, tolerance)
    for part in (agreed, minute_gaps(own), infinite_count(own, "va")):
        facts = with_row(facts, part)
    good = (F.col("equal_ratio") > 0.99) | ((F.col("jaccard") > 0.99) & F.col("passed"))
    bad = (
        (F.col("ratio") <= 0.99) | ~F.col("same") | (F.col("minute_gaps") > 0) | (F.col("infinite") > 0)
    )
    return facts.select(
        F.when(good, "true").when(bad, "false").otherwise("undecided").alias("verdict")
    )


def all_missing(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(factor, rejected): factors without a single value."""
    counts = df.agg(*[F.count(f).alias(f) for f in factors])
    cells = [F.struct(F.lit(f).alias("factor"), (F.col(f) == 0).alias("rejected")) for f in factors]
    return counts.select(F.inline(F.array(*cells)))
