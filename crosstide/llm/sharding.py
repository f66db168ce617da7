"""Weighted rendezvous sharding with gapless slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one slot window, about; also the longest run one row is unfolded to.
WINDOW_ROWS = 50_000


def stable_key(key: Column) -> Column:
    """The text form of a record key; NULL keys share the empty one."""
    return F.coalesce(key.cast("string"), F.lit(""))


def chosen_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for this key.

    A shard's score is ``-weight / ln(u)`` with ``u`` in (0, 1) drawn by XXH64
    from key and shard number alone.  Adding a shard changes no other score, so
    it only takes records into itself, in proportion to its weight.  Equal
    scores go to the higher shard number.  Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("give at least one shard, with positive weights")
    text = stable_key(key)

    def score(shard: int, weight: float) -> Column:
        drawn = F.xxhash64(F.concat(text, F.lit(f"#{shard}")))
        u = (F.shiftrightunsigned(drawn, 12).cast("double") + 0.5) * (2.0**-52)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    scored = [score(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def assigned(records: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``records`` with ``shard``, and ``grown_shard`` for the weights ``grown``.

    No shuffle: the key alone decides.  NULL keys go to one shard, repeated
    keys to the same shard.  Existing columns of these names are replaced.
    """
    out = records.withColumn("shard", chosen_shard(F.col(key), weights))
    return out.withColumn("grown_shard", chosen_shard(F.col(key), grown)) if grown else out


def with_slots(placed: DataFrame, key: str, rows: int) -> DataFrame:
    """``placed`` (all columns narrow, ``shard`` among them) with ``slot``: 0, 1, ... without a gap in each shard.

    Equal rows are counted before any shuffle, so a repeated record is one row
    until the end.  A shard is cut into hashed buckets of about ``WINDOW_ROWS``
    rows (``rows`` is the table's row count); positions inside a bucket and
    the buckets' first slots are separate windows, and neither sees a whole
    shard's rows.  The order is by bucket, then by the columns' values, so it
    does not depend on how the input is partitioned.
    """
    names = placed.columns
    shards = F.col("shard")
    buckets = max(1, -(-rows // WINDOW_ROWS))
    counted = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("copies_"))
    counted = counted.withColumn("bucket_", F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.lit(buckets)))
    inside = Window.partitionBy("shard", "bucket_").orderBy(*[F.col(c).asc_nulls_first() for c in names])
    counted = counted.withColumn("before_", F.sum("copies_").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies_"))
    sizes = placed.groupBy(shards, F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.lit(buckets)).alias("bucket_")).agg(F.count(F.lit(1)).alias("n_"))
    first = F.sum("n_").over(Window.partitionBy("shard").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    starts = sizes.select("shard", "bucket_", first.alias("first_"))
    runs = counted.join(starts, ["shard", "bucket_"]).select(*names, (F.col("first_") + F.col("before_")).alias("slot_"), "copies_")
    # A run of many equal rows is unfolded in two steps, spread between them.
    runs = runs.select(*names, "slot_", "copies_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1, F.lit(WINDOW_ROWS))).alias("from_"))
    runs = runs.select(*names, (F.col("slot_") + F.col("from_")).alias("slot_"), F.least(F.col("copies_") - F.col("from_"), F.lit(WINDOW_ROWS)).alias("run_"))
    return runs.select(*names, F.explode(F.sequence(F.col("slot_"), F.col("slot_") + F.col("run_") - 1)).alias("slot"))


def shard_table(records: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Every record's place: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 8; a NULL text has none.
    ``grown_shard`` is the place with one more shard of equal weight.  Only
    these narrow columns are shuffled, never the texts.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    narrow = records.select(F.col(key).alias("key_"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data.cast("binary")).cast("long").alias("text_crc32"))
    equal = [1.0] * shards
    placed = assigned(narrow, "key_", equal, [*equal, 1.0])
    out = with_slots(placed, "key_", records.count())
    return out.select(F.col("key_").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
