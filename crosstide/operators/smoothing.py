"""Exponentially weighted averages as linear recurrences carried from block to block."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions import rolling
from crosstide.functions.basics import div

#: Powers of ten that weights span inside a block; doubles hold 300.
BLOCK_DECADES = 200.0


@dataclass(frozen=True)
class Ewm:
    """One average: input column, and its decay as a span or an alpha."""

    value: str
    span: float | None = None
    alpha: float | None = None

    def decay(self) -> float:
        return self.alpha if self.alpha is not None else 2.0 / (self.span + 1.0)


def _block_rows(decay: float) -> int:
    """Rows over which a weight falls by ``BLOCK_DECADES`` powers of ten."""
    return max(1, math.floor(BLOCK_DECADES / -math.log10(1.0 - decay)))


def with_ewm(df: DataFrame, averages: dict[str, Ewm]) -> DataFrame:
    """Add adjusted exponential averages ``{new column: Ewm}``.

    A missing value (NULL, NaN) keeps its place in the decay and repeats the
    last average; before the first value there is none.

    The average is a decayed sum over a decayed count, both linear recurrences.
    An instrument's rows fall into blocks; inside a block they are running sums
    of growing weights, and the sums at the end of one block are carried to the
    rows of the next.  What lies two blocks back weighs less than 1e-200 of the
    current value.  All windows share the instrument's partitioning, so a panel
    from ``by_instrument`` is not shuffled again, and no row leaves the JVM.
    """
    history = Window.partitionBy("instrument").orderBy("datetime")
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    upto = history.rowsBetween(Window.unboundedPreceding, 0)
    own = [*df.columns, *averages]
    out = df.withColumn("_pos", F.row_number().over(history) - 1)
    by_block: dict[int, dict[str, Ewm]] = {}
    last: dict[str, Column] = {}
    for name, e in averages.items():
        x = F.col(e.value).cast("double")
        out = out.withColumn(f"_x_{name}", F.when(~F.isnan(x), x))
        if e.decay() >= 1.0:
            last[name] = F.last(f"_x_{name}", ignorenulls=True).over(upto)
        else:
            by_block.setdefault(_block_rows(e.decay()), {})[name] = e
    for rows, group in by_block.items():
        at = F.col("_pos") % rows
        inside = Window.partitionBy("instrument", "_block").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
        sums, carried, means = {}, {}, {}
        for name, e in group.items():
            keep, x = F.lit(1.0 - e.decay()), F.col(f"_x_{name}")
            weight = F.when(x.isNotNull(), F.pow(keep, -at))
            sums[f"_n_{name}"] = F.sum(x * weight).over(inside)
            sums[f"_d_{name}"] = F.sum(weight).over(inside)
            ends = F.pow(keep, F.lit(rows - 1))
            for part in ("n", "d"):
                end = F.when(at == rows - 1, F.coalesce(F.col(f"_{part}_{name}"), F.lit(0.0)) * ends)
                carried[f"_{part}c_{name}"] = F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0))
            now = lambda part, name=name, keep=keep: (
                F.col(f"_{part}_{name}") * F.pow(keep, at) + F.col(f"_{part}c_{name}") * F.pow(keep, at + 1)
            )
            means[f"_m_{name}"] = F.when(x.isNotNull(), now("n") / now("d"))
            last[name] = F.last(f"_m_{name}", ignorenulls=True).over(upto)
        out = out.withColumn("_block", F.floor(F.col("_pos") / rows)).withColumns(sums).withColumns(carried).withColumns(means)
    return out.withColumns(last).select(*own)


def with_ema(df: DataFrame, name: str, x: str, span: int) -> DataFrame:
    return with_ewm(df, {name: Ewm(x, span=span)})


def with_macd(df: DataFrame, name: str, x: str, short: int = 12, long: int = 26) -> DataFrame:
    both = with_ewm(df, {"_short": Ewm(x, span=short), "_long": Ewm(x, span=long)})
    return both.withColumn(name, F.col("_short") - F.col("_long")).drop("_short", "_long")


def with_rsi(df: DataFrame, name: str, x: str, span: int = 14) -> DataFrame:
    """Relative strength from averaged rises and falls; 100 where nothing fell."""
    step = rolling.delta(x, 1)
    moves = df.withColumn("_step", step).withColumns(
        {
            "_up": F.when(F.col("_step") > 0, F.col("_step")).when(F.col("_step") <= 0, 0.0),
            "_down": F.when(F.col("_step") < 0, -F.col("_step")).when(F.col("_step") >= 0, 0.0),
        }
    )
    smoothed = with_ewm(moves, {"_u": Ewm("_up", span=span), "_d": Ewm("_down", span=span)})
    strength = F.lit(100.0) - div(F.lit(100.0), F.lit(1.0) + div(F.col("_u"), F.col("_d")))
    only_rises = (F.col("_d") == 0) & (F.col("_u") > 0)
    strength = F.when(only_rises, 100.0).otherwise(strength)
    return smoothed.withColumn(name, strength).drop("_step", "_up", "_down", "_u", "_d")


def select_ewm(df: DataFrame, keys: Sequence[str], averages: dict[str, Ewm]) -> DataFrame:
    """As ``with_ewm`` on keys and inputs only."""
    inputs = sorted({e.value for e in averages.values()})
    return with_ewm(df.select(*keys, *inputs), averages)
