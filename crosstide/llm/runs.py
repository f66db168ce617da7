"""Periodic runs in token streams, found online by catchers over completed power-of-two blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many periods.
LEAST, EXPONENT = 24, 3
#: Words of the texts searched together.
CHUNK_WORDS = 200_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


class _Level:
    """What is kept of one block size: fingerprints of completed blocks, and of the latest suffixes."""

    def __init__(self, size: int, seed: int) -> None:
        self.tail = np.zeros(size, dtype=np.uint64)
        self.blocks = np.zeros(1, dtype=np.uint64)  # block j ends at j * size
        draw = np.random.default_rng(seed)
        self.left, self.right = (draw.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


class Catchers:
    """All runs of a stream of numbers, while the stream grows.

    A catcher is armed when a block of 2^k numbers is complete.  Once 2^k to
    2^(k+1) - 1 further numbers have come, it compares the fingerprint of its
    block with that of the suffix of the same length; equal ones are a repeat
    at that distance (the smallest blocks also watch shorter distances).  A
    repeat is then compared number by number to the left and, as numbers come,
    to the right, and ends where two numbers differ: a maximal stretch of that
    period.  A run of ``exponent`` >= 3 periods q holds a whole block and its
    copy q further for the k with 2^k <= q < 2^(k+1), so none is missed;
    fingerprints only propose, numbers decide.

    ``append`` takes any number of numbers at a time; all steps of one call
    advance together as arrays.
    """

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT, longest_period: int | None = None) -> None:
        if exponent < 3 or least < 1:
            raise ValueError("runs need three periods and one number at least")
        self.least, self.exponent, self.longest = least, exponent, longest_period
        self.base = max(0, ((least + 2) // 3).bit_length() - 1)
        self.n = 0
        self.values = np.zeros(1024, dtype=np.int64)
        self.owner = np.full(1024, -1, dtype=np.int64)  # a run that holds this place
        self.levels: list[_Level] = []
        self.stretches: list[list[int]] = []  # start, end, period
        self.open: dict[int, int] = {}  # period: the stretch that reaches the end of the stream
        self.ended: dict[int, int] = {}  # period: where its last stretch ended

    def append(self, values: np.ndarray) -> None:
        old, m = self.n, len(values)
        if not m:
            return
        while len(self.values) < old + m:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.owner = np.concatenate([self.owner, np.full_like(self.owner, -1)])
        self.values[old : old + m] = values
        self.n = old + m
        for period in sorted(self.open):
            self._advance(period, old)
        prints = _mixed(values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ends = np.arange(old + 1, self.n + 1)
        k = 0
        while 1 << k <= self.n and (k <= self.base or self.longest is None or 1 << k <= self.longest):
            size = 1 << k
            if k == len(self.levels):
                self.levels.append(_Level(size, k))
            level = self.levels[k]
            level.blocks = np.concatenate([level.blocks, prints[(-(old + 1)) % size :: size]])
            if k >= self.base:
                self._watch(level, size, ends, prints)
            wide = np.concatenate([level.tail, prints])
            level.tail = wide[-size:]
            prints = _mixed(wide[:m] * level.left + prints * level.right)
            k += 1

    def _watch(self, level: _Level, size: int, ends: np.ndarray, prints: np.ndarray) -> None:
        """The repeats that the catchers of one level see at these steps."""
        block = ends // size  # the last complete one; the catcher on duty watches the one before
        if size == 1 << self.base:
            seen = np.flatnonzero((prints == level.blocks[block]) & (block > 0) & (ends % size > 0))
            self._follow(ends[seen], ends[seen] % size, size)
        seen = np.flatnonzero((prints == level.blocks[block - 1]) & (block > 1))
        self._follow(ends[seen], ends[seen] % size + size, size)

    def _follow(self, ends: np.ndarray, periods: np.ndarray, size: int) -> None:
        # Inside a run of period p, repeats at its multiples are the same run.
        if len(ends) and self.stretches:
            table = np.array(self.stretches, dtype=np.int64)
            mine = self.owner[ends - 1]
            start, period = table[mine, 0], table[mine, 2]
            fresh = (mine < 0) | (start > ends - size - periods) | (periods % period != 0)
            ends, periods = ends[fresh], periods[fresh]
        order = np.lexsort((ends, periods))
        for end, period in zip(ends[order].tolist(), periods[order].tolist(), strict=True):
            if period in self.open or end <= self.ended.get(period, 0):
                continue
            at = int(self.owner[end - 1])
            if at >= 0 and period % self.stretches[at][2] == 0 and self.stretches[at][0] <= end - size - period:
                continue
            start = self._left(end - period, period)
            if start > end - period - size:
                continue  # equal fingerprints of different blocks
            self.open[period] = len(self.stretches)
            self.stretches.append([start, end, period])
            self._advance(period, end)

    def _left(self, j: int, period: int) -> int:
        v, step = self.values, 64
        while j > 0:
            low = max(0, j - step)
            differ = np.flatnonzero(v[low:j] != v[low + period : j + period])
            if len(differ):
                return low + int(differ[-1]) + 1
            j, step = low, step * 2
        return 0

    def _advance(self, period: int, at: int) -> None:
        """Carries an open stretch on from ``at``; it closes where numbers differ."""
        v, step, end = self.values, 64, self.n
        while at < self.n:
            high = min(self.n, at + step)
            differ = np.flatnonzero(v[at:high] != v[at - period : high - period])
            if len(differ):
                end = at + int(differ[0])
                break
            at, step = high, step * 2
        which = self.open[period]
        stretch = self.stretches[which]
        stretch[1] = end
        if self._is_run(stretch):
            self.owner[stretch[0] : end] = which
        if end < self.n:
            del self.open[period]
            self.ended[period] = end

    def _is_run(self, stretch: list[int]) -> bool:
        start, end, period = stretch
        return end - start >= max(self.least, self.exponent * period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of every run so far, by start, then period.

        Stretches over the same numbers merge into the one of the smallest period.
        """
        smallest: dict[tuple[int, int], int] = {}
        for stretch in self.stretches:
            if self._is_run(stretch):
                start, end, period = stretch
                smallest[start, end] = min(period, smallest.get((start, end), period))
        return sorted(((s, e, p) for (s, e), p in smallest.items()), key=lambda r: (r[0], r[2]))


def found_in(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text given as its words, and the text without the words a run repeats.

    The texts are one stream; between two of them stands a number that occurs once.
    """
    words = [w for one in texts for w in one]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths) - lengths
    numbers = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    stream = np.empty(len(words) + len(texts), dtype=np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), lengths)
    stream[place] = numbers
    stream[starts + lengths + np.arange(len(texts))] = -1 - np.arange(len(texts))
    catchers = Catchers(least, exponent, int(lengths.max(initial=0)) // exponent)
    catchers.append(stream)
    runs: list[list[dict]] = [[] for _ in texts]
    kept = np.ones(len(words), dtype=bool)
    first = starts + np.arange(len(texts))  # where a text begins in the stream
    for start, end, period in catchers.runs():
        text = int(np.searchsorted(first, start, "right")) - 1
        runs[text].append({"start": start - int(first[text]), "length": end - start, "period": period})
        kept[start + period - text : end - text] = False
    collapsed = []
    for one, mine, at in zip(texts, runs, starts.tolist(), strict=True):
        collapsed.append(b" ".join(one if not mine else [one[i] for i in np.flatnonzero(kept[at : at + len(one)]).tolist()]))
    return runs, collapsed


def repetitions(docs: DataFrame, key: str, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``key``, ``runs`` and ``collapsed`` for every row of ``docs``.

    Words are what white space (ASCII) separates.  A run is a stretch of words
    with smallest period q, at least ``least`` words and ``exponent`` periods
    long, that goes on to neither side; ``runs`` lists (start, length, period)
    by start, then period.  ``collapsed`` is the text, words joined by one
    space, without the words that any run holds after its first period.  NULL,
    empty and blank texts have no runs and an empty ``collapsed``.  Every row
    is searched by itself: repeated rows give equal results, an empty table an
    empty one.  Other columns are ignored, whatever their names.

    A map over rows without a shuffle; a text of n words takes O(n log n).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            done = size = 0
            for i, one in enumerate(batch.column(1)):
                texts.append((one.as_py() or b"").split())
                size += len(texts[-1])
                if size >= CHUNK_WORDS or i == batch.num_rows - 1:
                    runs, collapsed = found_in(texts, least, exponent)
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    columns = [batch.column(0).slice(done, len(texts)), pa.array(runs, kind), pa.array(collapsed, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "runs", "collapsed"])
                    texts, done, size = [], i + 1, 0

    rows = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("x"))
    out = rows.mapInArrow(search, f"key {dict(docs.dtypes)[key]}, runs {RUNS}, collapsed string")
    return out.select(F.col("key").alias(key), "runs", "collapsed")


def strongest(runs: str = "runs") -> F.Column:
    """The run of the greatest length / period, compared exactly; ties by start, then period; NULL without runs."""

    def order(x, y):
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        later = F.struct(x["start"], x["period"]) > F.struct(y["start"], y["period"])
        return F.when(more > less, -1).when(more < less, 1).when(later, 1).otherwise(-1)

    return F.get(F.array_sort(F.col(runs), order), F.lit(0))
