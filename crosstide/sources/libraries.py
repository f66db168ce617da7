"""Factor libraries: nested JSON documents and CSV lists as factor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.basics import rounded
from crosstide.session import cut_lineage
from crosstide.sources.panel import keep_last

FACTOR = (
    "struct<factor_id:string,factor_name:string,factor_expression:string,"
    "factor_description:string,factor_formulation:string,quality:string,"
    "cache_location:map<string,string>,"
    "metadata:struct<experiment_id:string,round_number:int,evolution_phase:string,"
    "trajectory_id:string,parent_trajectory_ids:array<string>,created_at:string>,"
    "backtest_results:map<string,string>,feedback:map<string,string>>"
)
LIBRARY = (
    "metadata struct<created_at:string,last_updated:string,total_factors:int,version:string>,"
    f"factors map<string,{FACTOR}>"
)


def read_libraries(
    spark: SparkSession, paths: str | Sequence[str], whole_files: bool = True
) -> DataFrame:
    """One row per factor with an expression; a missing name falls back to the id.

    A library is one JSON document: one per file, indented or not, or one per
    line without ``whole_files``.  A document must fit one row.  One that does
    not parse fails the read; a metric that is no number is NULL.
    """
    text = spark.read.text(paths, wholetext=whole_files).where(F.length(F.trim("value")) > 0)
    parsed = text.select(F.from_json("value", LIBRARY, {"mode": "FAILFAST"}).alias("doc"))
    rows = parsed.select(
        F.col("doc.metadata.version").alias("version"), F.explode("doc.factors").alias("id", "f")
    )
    return rows.select(
        F.col("id").alias("factor_id"),
        F.coalesce("f.factor_name", "id").alias("factor_name"),
        "f.factor_expression",
        "f.factor_description",
        "f.quality",
        "f.cache_location",
        F.transform_values("f.backtest_results", lambda k, v: v.try_cast("double")).alias("backtest_results"),
        "version",
    ).where(F.length("factor_expression") > 0)


def first_factors(df: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """At most ``most`` factors in a stated order (distributed top-n)."""
    return df.orderBy(*order).limit(most)


def with_quality(df: DataFrame, quality: str) -> DataFrame:
    return df.where(F.col("quality") == quality)


def read_factor_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "factor_name string, factor_expression string"
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return df.where(hit)


# fixed values: metric names in order of preference
RATIO_KEYS = (
    "1day.excess_return_without_cost.information_ratio",
    "1day.excess_return_with_cost.information_ratio",
)
METRIC_ALIASES = {
    "ic": ("IC", "ic", "1day.excess_return_without_cost.information_coefficient"),
    "icir": ("ICIR", "icir", "1day.excess_return_without_cost.information_coefficient_ir"),
    "rank_ic": ("RankIC", "Rank IC", "rank_ic", "1day.excess_return_without_cost.rank_ic"),
    "rank_icir": ("RankICIR", "Rank ICIR", "rank_icir", "rank_ic_ir", "1day.excess_return_without_cost.rank_ic_ir"),
    "annual_return": (
        "1day.excess_return_with_cost.annualized_return",
        "1day.excess_return_without_cost.annualized_return",
        "annualized_return",
        "Annualized Return",
    ),
    "information_ratio": (
        "1day.excess_return_with_cost.information_ratio",
        "1day.excess_return_without_cost.information_ratio",
        "information_ratio",
        "Information Ratio",
    ),
    "max_drawdown": (
        "1day.excess_return_with_cost.max_drawdown",
        "1day.excess_return_without_cost.max_drawdown",
        "max_drawdown",
        "Max Drawdown",
    ),
}


def metric(metrics: str, name: str) -> Column:
    """First metric present among a name's aliases."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in METRIC_ALIASES[name]])


def quality_class(metrics: str) -> Column:
    """high above 0.5, medium above 0.1, else low, by information ratio; low
    without any metric, medium without a ratio."""
    m = F.col(metrics)
    any_ratio = F.map_values(F.map_filter(m, lambda k, v: F.contains(k, F.lit("information_ratio")) & v.isNotNull()))
    ratio = F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in RATIO_KEYS], F.get(any_ratio, F.lit(0)))
    return (
        F.when(m.isNull() | (F.size(m) == 0), "low")
        .when(ratio.isNull(), "medium")
        .when(ratio > 0.5, "high")
        .when(ratio > 0.1, "medium")
        .otherwise("low")
    )


def stored_metrics(metrics: str) -> Column:
    """Metric map in storage form: non-finite to NULL, eight decimals."""
    return F.transform_values(metrics, lambda k, v: rounded(v, 8))


def factor_id(name: Column, expr: Column) -> Column:
    """First 16 hex digits of the digest of name and expression."""
    return F.substring(F.md5(F.concat_ws("_", name, expr)), 1, 16)


def upsert(library: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Append new rows; per key the row with the largest ``order`` stays."""
    return keep_last(library.unionByName(new), [key], [order])


def upsert_store(new: DataFrame, path: str, key: str, order: str, parts: int = 64) -> list[int]:
    """``upsert`` into a stored library: rewrites only the parts that ``new`` touches.

    The library at ``path`` is Parquet, partitioned by a hash of ``key`` into
    ``parts`` folders (made by the first call, and the same for later ones).
    Touched folders are merged and replaced when all of them are written, so a
    write that fails leaves the old library.  Returns the touched parts; an
    empty ``new`` touches none.  NULL keys are one key.
    """
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    rows = cut_lineage(new.withColumn("_part", part))
    touched = sorted(r["_part"] for r in rows.select("_part").distinct().collect())  # ``parts`` numbers at most
    if not touched:
        return []
    try:
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("_part").isin(touched))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = rows.limit(0)
    merged = upsert(old, rows, key, order).repartition(len(touched), "_part")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return touched


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored library's rows."""
    return spark.read.parquet(path).drop("_part")


def quality_counts(df: DataFrame, quality: str) -> DataFrame:
    return df.groupBy(quality).agg(F.count(F.lit(1)).alias("factors"))


def best_factors(df: DataFrame, score: str, tie: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), tie).limit(n)


def cache_summary(df: DataFrame, status: str) -> DataFrame:
    """Totals by cache status, one row."""
    states = ("h5_cached", "md5_cached", "need_compute")
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in states]
    )
