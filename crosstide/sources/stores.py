"""Stored factor values and reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = "expression_key string, run string"


def write_matrix(panel: DataFrame, factors: Sequence[tuple[str, Column]], path: str) -> None:
    """Write named factors over the panel's keys; a repeated name keeps its
    last definition.  Files are clustered by date range for later date scans."""
    named = dict(factors)
    matrix = panel.select("datetime", "instrument", *[v.alias(k) for k, v in named.items()])
    matrix.repartitionByRange("datetime", "instrument").write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, keys: Sequence[str] = ("instrument", "datetime")) -> None:
    """Write a table in ``buckets`` files by a hash of ``keys``, each sorted by them.

    Two tables written with the same keys and number of buckets join on the
    keys without an exchange.  The layout is kept beside the rows.
    """
    spark = df.sparkSession
    name = f"layout_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    layout = [(df.schema.json(), buckets, list(keys))]
    spark.createDataFrame(layout, "schema string, buckets int, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed`` with its layout, for any session."""
    layout = spark.read.schema("schema string, buckets int, keys array<string>").json(f"{path}/_layout").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(layout.schema)))
    name = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"
    keys = ", ".join(f"`{k}`" for k in layout["keys"])
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def with_static(features: DataFrame, static: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join precomputed features to expression features."""
    return features.join(static, list(keys), "left")


def expression_key(expr: str | Column) -> Column:
    return F.md5(F.lit(expr) if isinstance(expr, str) else expr)


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """(expression_key, run) of the store's complete keys, from its manifest."""
    try:
        return spark.read.schema(KEYS).parquet(f"{path}/keys")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEYS)


def fill_store(panel: DataFrame, factors: dict[str, Column], path: str) -> list[str]:
    """Compute the expressions the store lacks and append them; returns those.

    Values go to a folder of this run; only when they are written does the
    manifest name the keys, so a failed run leaves no half key behind and two
    writers at once do no harm (readers take one run per key).  Rows are laid
    out by key and date range before writing, which bounds the files.  The
    list of expressions is the caller's program text, so handling it on the
    driver is bounded; values never pass through it.
    """
    spark = panel.sparkSession
    wanted = spark.createDataFrame([(e,) for e in factors], "expression string").withColumn(
        "expression_key", expression_key(F.col("expression"))
    )
    missing = [
        row.expression
        for row in wanted.join(stored_keys(spark, path), "expression_key", "left_anti").collect()
    ]
    if missing:
        run = uuid.uuid4().hex
        cells = [
            F.struct(expression_key(e).alias("expression_key"), factors[e].cast("double").alias("value"))
            for e in missing
        ]
        rows = panel.select("datetime", "instrument", F.array(*cells).alias("_c"))
        long = rows.select("datetime", "instrument", F.inline("_c"))
        laid = long.repartitionByRange("expression_key", "datetime", "instrument")
        laid.write.partitionBy("expression_key").parquet(f"{path}/values/run={run}")
        keys = wanted.where(F.col("expression").isin(missing)).select("expression_key", F.lit(run).alias("run"))
        keys.coalesce(1).write.mode("append").parquet(f"{path}/keys")
    return missing


def read_store(spark: SparkSession, path: str, expressions: Sequence[str]) -> DataFrame:
    """Values of some expressions; only their partitions are read.

    (expression_key, datetime, instrument, value), instruments of the panel's
    own type.  Expressions the store lacks have no rows.
    """
    digests = [hashlib.md5(e.encode()).hexdigest() for e in expressions]
    held = stored_keys(spark, path).where(F.col("expression_key").isin(digests))
    runs = held.groupBy("expression_key").agg(F.min("run").alias("run")).collect()
    if not runs:
        return spark.createDataFrame([], "expression_key string, datetime date, instrument string, value double")
    chosen = F.lit(False)
    for row in runs:
        chosen = chosen | ((F.col("expression_key") == row.expression_key) & (F.col("run") == row.run))
    values = spark.read.option("basePath", f"{path}/values").parquet(*{f"{path}/values/run={row.run}" for row in runs})
    typed = values.withColumns({c: F.col(c).cast("string") for c in ("expression_key", "run")})
    return typed.where(chosen).select("expression_key", "datetime", "instrument", "value")


def write_report(daily: DataFrame, path: str) -> None:
    """Daily and cumulative excess as CSV; one row per date, so one file."""
    daily.select(
        F.col("datetime").alias("date"),
        F.col("excess").alias("daily_excess_return"),
        F.col("cumulative").alias("cumulative_excess_return"),
    ).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    schema = "date date, daily_excess_return double, cumulative_excess_return double"
    return spark.read.csv(path, header=True, schema=schema)


def append_summary(summary: DataFrame, path: str) -> None:
    """Add a run's metric row to the batch summary."""
    summary.write.mode("append").json(path)


TRAJECTORY = (
    "trajectory_id string, direction_id int, round_idx int, phase string, hypothesis string, "
    "factors array<struct<name:string,expression:string,description:string>>, "
    "backtest_metrics map<string,double>, feedback string, parent_ids array<string>, created_at string"
)


def save_pool(pool: DataFrame, path: str) -> None:
    pool.write.mode("overwrite").json(path)


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY).json(path)
