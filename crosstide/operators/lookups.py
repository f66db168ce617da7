"""Joining a large table with a keyed table whose size is only known at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table is broadcast if it has at most so many rows, and so many bytes written out as text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
SALTS = 16


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int | None = None) -> bool:
    """Whether ``df`` may be broadcast: counted up to one row more than the bound, and its values measured."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    count, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return count <= rows and (total or 0) <= (BROADCAST_BYTES if size is None else size)


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    most: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``left`` (any skew) with ``right`` (one row per key).

    ``right`` is counted and measured; up to ``most`` rows of bounded size it is broadcast.  Beyond that
    both sides are shuffled with a salt taken from the ``spread`` columns, so a
    key that holds a large part of ``left`` is shared by many tasks.
    """
    if is_small(right, most):
        return left.join(F.broadcast(right), list(on), how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    copies = right.withColumn("_salt", F.explode(salts))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_many(left: DataFrame, right: DataFrame, on: str, spread: Sequence[str]) -> DataFrame:
    """Join ``left`` with ``right`` where a key has many rows on both sides; both are shuffled.

    ``left`` is dealt over salts by the ``spread`` columns, ``right`` copied to
    each, so the pairs of one key are made by SALTS tasks.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return salted.join(right.withColumn("_salt", F.explode(salts)), [on, "_salt"]).drop("_salt")


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to every row."""
    one = F.lit(1)
    return (
        df.withColumn("_one", one).join(F.broadcast(row.withColumn("_one", one)), "_one", "left").drop("_one")
    )
