"""What the registered queries share: the registry and the weekly panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.sources import panel as panels

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nudge(digits: int) -> str:
    """A shift far below the rounding step.  Prices are cents over small
    integers, so exact halves are common, and engines break halves differently."""
    return f"3.7e-{digits + 4}"


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") + float(nudge(digits)), digits) + F.lit(0.0)


def panel(spark: SparkSession, sf: str, at_once: bool = False) -> DataFrame:
    """The weekly supplier panel with ``ret`` and ``xn``.

    ``xn`` is close with gaps (NULL on thin weeks), so operators meet missing
    values; ``yn`` likewise from vwap.  ``at_once`` as in ``weekly_panel``.
    """
    weekly = panels.weekly_panel(table(spark, sf, "lineitem"), at_once)
    bars = panels.with_return(weekly if at_once else panels.by_instrument(weekly))
    return bars.withColumns(
        {
            "xn": F.when(F.col("volume") >= 30, F.col("close")),
            "yn": F.when(F.col("volume") <= 120, F.col("vwap")),
        }
    )


PANEL_SQL = """
bars AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime,
         l_suppkey AS instrument,
         arg_min(px, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS open,
         max(px) AS high, min(px) AS low,
         arg_max(px, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS close,
         sum(l_quantity) AS volume,
         sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS vwap
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS px FROM lineitem)
  GROUP BY 1, 2),
panel AS (
  SELECT *, close / nullif(lag(close) OVER h, 0) - 1 AS ret,
         CASE WHEN volume >= 30 THEN close END AS xn,
         CASE WHEN volume <= 120 THEN vwap END AS yn,
         row_number() OVER h AS rn
  FROM bars
  WINDOW h AS (PARTITION BY instrument ORDER BY datetime))
"""


def with_panel(body: str, *more: str) -> str:
    """SQL text with the panel in front; ``more`` are further named tables."""
    return "WITH " + ",".join([PANEL_SQL, *more]) + "\n" + body


def rs(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"round(CAST({expr} AS DOUBLE) + CAST({nudge(digits)} AS DOUBLE), {digits}) + 0.0"
