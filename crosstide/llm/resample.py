"""Resampling documents towards a target distribution: hashed n-gram weights and a distributed quickselect."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import discard, free_name, written
from crosstide.session import shuffle_width

BUCKETS = 10_000
#: Words a text needs to be drawn, and the drawn share in hundredths.
MIN_WORDS, PERCENT = 20, 25
#: Bytes of the texts hashed together.
CHUNK_BYTES = 2_000_000
#: Pivot keys of one round of the selection.
PIVOTS = 15

# A-Z become a-z; digits, letters and all bytes of other characters stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _hashed(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the bucket of every word and of every word with its successor, and which words have one."""
    texts = [(one.as_py() or b"").translate(_FOLD).split() for one in column]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    words = [w for one in texts for w in one]
    n = len(words)
    single = np.fromiter(map(crc32, words), dtype=np.int64, count=n)
    spaced = map(crc32, repeat(b" "), single.tolist())
    pair = np.zeros(n, dtype=np.int64)
    pair[: max(n - 1, 0)] = np.fromiter(map(crc32, words[1:], spaced), dtype=np.int64, count=max(n - 1, 0))
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    return lengths, single % buckets, pair % buckets, inner


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``CHUNK_BYTES`` of text (the last column), so a task's memory is bounded."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def feature_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; a task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in _chunks(batches):
            _, single, pair, inner = _hashed(batch.column(0), buckets)
            total += np.bincount(single, minlength=buckets) + np.bincount(pair[inner], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("x"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's log ratio of target to corpus in thousandths, add-one smoothed, rounded down.

    ``buckets`` numbers reach the driver, whatever the size of the tables.
    """

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        for row in feature_counts(df, text, buckets).collect():
            out[row["bucket"]] = row["n"]
        return out

    corpus, wanted = counted(docs), counted(target)
    whole, whole_wanted = float(corpus.sum() + buckets), float(wanted.sum() + buckets)
    ratio = ((float(t) + 1.0) * whole / ((float(s) + 1.0) * whole_wanted) for s, t in zip(corpus.tolist(), wanted.tolist(), strict=True))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], dtype=np.int64)


def weighted(docs: DataFrame, key: str, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight`` (mean gain of the features, rounded down; none: 0)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            words, single, pair, inner = _hashed(batch.column(1), buckets)
            each = gain[single] + np.where(inner, gain[pair], 0)
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(words)
            features = words + np.maximum(words - 1, 0)
            weight = (upto[ends] - upto[ends - words]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["key", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("x"))
    out = rows.mapInArrow(weigh, f"key {dict(docs.dtypes)[key]}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("key", key)


def gumbel(key: str, seed: int) -> Column:
    """Gumbel noise of the key in thousandths, rounded down; a NULL key has that of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit)))


def _composite(score: str, key: str) -> Column:
    """Rows in order: higher scores first, ties to the smaller key, NULL keys last."""
    return F.struct((-F.col(score)).alias("a"), F.col(key).isNull().alias("b"), F.col(key).alias("c"))


def kth_key(rows: DataFrame, score: str, key: str, k: int, seed: int = 0, pivots: int = PIVOTS) -> Column | None:
    """The composite key of the k-th row (from 1), as a literal; None if there are fewer rows.

    A quickselect in which every round is a few passes over the rows still in
    question: random rows give pivot keys, one aggregation counts the rows
    below and at each pivot, and only the rows strictly between the two pivots
    around the k-th stay, stored for the next round.  A key that many rows
    share is one pivot, whatever its rows.
    """
    live = rows.select(_composite(score, key).alias("k"))
    kind = live.schema["k"].dataType.simpleString()
    mine = False
    if k < 1:
        return None
    for turn in range(10_000):
        luck = F.xxhash64(F.lit(seed), F.lit(turn), "k")
        drawn = {tuple(r["k"]) for r in live.orderBy(luck, "k").limit(pivots).collect()}
        keys = [F.struct(*[F.lit(x) for x in p]).cast(kind) for p in drawn]
        if not keys:
            return None
        counted = live.agg(
            *[F.count_if(F.col("k") < p).alias(f"b{i}") for i, p in enumerate(keys)],
            *[F.count_if(F.col("k") == p).alias(f"e{i}") for i, p in enumerate(keys)],
        ).first()
        low = high = None
        for i in sorted(range(len(keys)), key=lambda i: counted[f"b{i}"]):
            below, equal = counted[f"b{i}"], counted[f"e{i}"]
            if below < k <= below + equal:
                if mine:
                    discard(live)
                return keys[i]
            if below + equal < k:
                low, passed = i, below + equal
            elif high is None:
                high = i
        inside = live
        if low is not None:
            inside, k = inside.where(F.col("k") > keys[low]), k - passed
        if high is not None:
            inside = inside.where(F.col("k") < keys[high])
        narrowed = written(inside, "live")
        if mine:
            discard(live)
        live, mine = narrowed, True
    raise RuntimeError("the selection made no progress")


def ranked(rows: DataFrame, score: str, key: str, k: int, eligible: Column, seed: int = 0) -> DataFrame:
    """``rows`` with ``rank`` 1 to k for the k eligible ones of highest score (ties to the smaller key), else NULL.

    Only the winners are sorted: dealt by key ranges, sorted inside each, and
    numbered by the sizes of the ranges before.  Rows with the same score and
    key are told apart by their place after the sort.
    """
    cut = kth_key(rows.where(eligible), score, key, k, seed)
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    spark = rows.sparkSession
    won = F.coalesce(eligible, F.lit(False)) & (_composite(score, key) <= cut)
    order = [F.col(score).desc(), F.col(key).asc_nulls_last()]
    place = free_name(rows, "place")
    dealt = rows.where(won).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    winners = written(dealt.withColumn(place, F.monotonically_increasing_id()), "winners")
    part = F.shiftright(place, 33).alias("part")
    sizes = sorted(winners.groupBy(part).count().collect())  # a row per range
    before, total = [], 0
    for one in sizes:
        before.append((one["part"], total))
        total += one["count"]
    offsets = spark.createDataFrame(before, "part long, rows_before long")
    numbered = (
        winners.select(F.struct(*rows.columns).alias("row"), part, (F.col(place) % (1 << 33) + 1).alias("nth"))
        .join(F.broadcast(offsets), "part")
        .select("row.*", (F.col("rows_before") + F.col("nth")).alias("rank"))
    )
    drawn = numbered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.unionByName(rows.where(~won).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, key: str, text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of ``docs``.

    Features are words and pairs of neighbouring words (A-Z lowered; any other
    ASCII character than digits and letters separates), hashed into
    ``buckets``.  A document's weight is the mean log ratio of ``target`` to
    ``docs`` over its features; its score adds Gumbel noise drawn from its key,
    so the highest scores are a sample without replacement in proportion to
    the weights.  Of the documents with ``min_words`` words or more, ``percent``
    in a hundred (rounded down) are drawn and ranked; ties go to the smaller key.

    NULL and empty texts have no features and weight 0; a NULL key comes last
    among ties; repeated rows are rows of their own (equal scores, neighbouring
    ranks); an empty ``docs`` gives an empty table, an empty ``target`` counts
    of zero.  Other columns are ignored, whatever their names.
    """
    gain = gains(docs, target, text, buckets)
    scored = weighted(docs, key, gain, text)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(key, seed)), "scores")
    eligible = F.col("n_words") >= min_words
    drawn = scored.where(eligible).count() * percent // 100
    return ranked(scored, "score", key, drawn, eligible, seed)
