"""SimHash near-duplicates by multi-index hashing.

Fingerprints link when at most ``max_bits`` of their 64 bits differ.  The bits
are cut into segments with an error budget each, so that any linked pair meets
the budget in at least one segment.  Every distinct fingerprint is stored under
its value in each segment, looks up the small Hamming ball round that value,
and the full distance of each hit is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import components, free_name, matched, runs, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Removed documents (16 bytes each) that are broadcast at most.
SENT = 1_000_000
#: Fingerprints with one segment value that are joined with each other directly, and that make up a block.
CROWD = 1_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned SimHash of a text's word shingles; NULL and texts without words give 0.

    A-Z are lower-cased, shingles of ``width`` words (repeats included; a
    shorter text is one shingle) are joined by a space and hashed with XXH64.
    A bit is set if it is set in more than half of the hashes.
    """
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(width, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):  # a very long text needs no more memory than a long one
        part = hashes[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) bigint column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def segments(max_bits: int, count: int = 3) -> list[tuple[int, int, int]]:
    """(first bit, bits, error budget) of each segment.

    Budgets plus one add up to ``max_bits + 1``: a pair that overran every
    budget would differ in more bits than that.  A segment that would need a
    negative budget is left out, so at most ``max_bits + 1`` segments are used.
    """
    count = min(count, max_bits + 1)
    budget, more = divmod(max_bits + 1, count)
    width, wider = divmod(64, count)
    out, at = [], 0
    for i in range(count):
        bits = width + (i >= count - wider)
        out.append((at, bits, budget - 1 + (i < more)))
        at += bits
    return out


def _looked_up(t: int, key: Column, ball: Column) -> Column:
    asked = F.filter(ball, lambda x: key.bitwiseAND(x["low"]) == 0)
    return F.transform(asked, lambda x: F.struct(F.lit(t).alias("t"), key.bitwiseXOR(x["m"]).alias("key"), (x["m"] != 0).alias("moved")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _entries(prints: DataFrame, max_bits: int, count: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """Each fingerprint under its own segment values, and under those it looks up; the segments."""
    (col,) = prints.columns
    cut = segments(max_bits, count)
    keys, probes = [], []
    for t, (at, bits, budget) in enumerate(cut):
        key = F.shiftrightunsigned(F.col(col), at).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
        # Of two values that differ by a mask, only the one without the mask's lowest bit looks up the other.
        masks = [sum(1 << b for b in ball) for n in range(budget + 1) for ball in combinations(range(bits), n)]
        ball = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(_signed(m & -m)).alias("low")) for m in masks])
        probes.append(_looked_up(t, key, ball))
    stored = prints.select(F.col(col).alias("v"), F.inline(F.array(*keys)))
    asked = prints.select(F.col(col).alias("u"), F.inline(F.concat(*probes)))
    return stored, asked, cut


def links(prints: DataFrame, max_bits: int = 4, count: int = 3) -> DataFrame:
    """(u, v): every pair of different fingerprints within ``max_bits``, once.

    ``prints`` has one bigint column of distinct values.  A pair found in
    several segments is kept in the first of them only.
    """
    stored, asked, cut = _entries(prints, max_bits, count)
    return _hits(asked.join(stored, ["t", "key"]), cut, max_bits)


def _hits(met: DataFrame, cut: list[tuple[int, int, int]], max_bits: int) -> DataFrame:
    differ = F.col("u").bitwiseXOR(F.col("v"))

    def within(t: int):
        at, bits, budget = cut[t]
        return F.bit_count(differ.bitwiseAND(F.lit(_signed(((1 << bits) - 1) << at)))) <= budget

    first = F.lit(True)
    for t in range(1, len(cut)):
        for before in range(t):
            first = first & ((F.col("t") != t) | ~within(before))
    return met.where((F.col("moved") | (F.col("u") < F.col("v"))) & (F.bit_count(differ) <= max_bits) & first).select("u", "v")


def forest(prints: DataFrame, max_bits: int = 4, count: int = 3, crowd: int = CROWD) -> DataFrame:
    """(u, v): links with the same components as ``links``, however many fingerprints share a segment value.

    A value that more than ``crowd`` fingerprints hold does not join them all.
    All that hold it or look it up are first compared with the smallest holder;
    what that leaves in several groups is dealt into blocks, and two blocks
    give one link per group they join.  So no step lists the pairs of a value,
    and no task holds more than two blocks.
    """
    stored, asked, cut = _entries(prints, max_bits, count)
    crowded = stored.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("hub")).where(F.col("n") > crowd)
    crowded = written(crowded.select("t", "key", "hub"), "crowded")
    if not crowded.take(1):
        return _hits(asked.join(stored, ["t", "key"]), cut, max_bits)
    few = crowded.limit(SENT + 1).count() <= SENT
    hot = F.broadcast(crowded) if few else crowded
    plain = _hits(asked.join(hot, ["t", "key"], "left_anti").join(stored.join(hot, ["t", "key"], "left_anti"), ["t", "key"]), cut, max_bits)
    members = stored.select("t", "key", F.col("v").alias("p")).unionAll(asked.where("moved").select("t", "key", F.col("u").alias("p")))
    members = written(members.join(hot, ["t", "key"]), "crowd")
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("hub"))) <= max_bits
    stars = written(members.where(near & (F.col("p") != F.col("hub"))).select(F.col("p").alias("u"), F.col("hub").alias("v")).distinct(), "stars")
    group = components(stars).select(F.col("node").alias("p"), F.col("component").alias("g"))
    labelled = written(members.join(group, "p", "left").select("t", "key", "p", F.coalesce("g", "p").alias("g")), "labelled")
    mixed = labelled.groupBy("t", "key").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts")).where("x < y")
    mixed = written(mixed.select("t", "key", "parts"), "mixed")
    dealt = labelled.join(F.broadcast(mixed) if few else mixed, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int"))
    paired = dealt.select("t", "key", "p", "g", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = paired.select("t", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "p", "g")
    keys = ["t", "key", "low", "high"]
    across = paired.repartition(*keys).sortWithinPartitions(*keys, "part").mapInArrow(_across(max_bits), "u long, v long")
    return plain.unionAll(stars).unionAll(across)


def _across(max_bits: int):
    """Links between the groups of one or two blocks, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 4):
            part, p, g = (rows[c].to_numpy() for c in ("part", "p", "g"))
            bits = p.view(np.uint64)
            one = rows["low"][0].as_py() == rows["high"][0].as_py()
            cut = 0 if one else int(np.searchsorted(part, rows["high"][0].as_py()))
            left, right = (np.arange(len(p)), np.arange(len(p))) if one else (np.arange(cut), np.arange(cut, len(p)))
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            found: list[tuple[int, int]] = []
            for i in left.tolist():
                close = right[np.bitwise_count(bits[right] ^ bits[i]) <= max_bits]
                for j in close[g[close] != g[i]].tolist():
                    a, b = top(int(g[i])), top(int(g[j]))
                    if a != b:
                        above[max(a, b)] = min(a, b)
                        found.append((int(p[i]), int(p[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


def _classified(docs: DataFrame, key: str, text: str, width: int, max_bits: int) -> DataFrame:
    """(k, h, p, name) of every row: key, hash of the text, fingerprint, smallest key of its component."""
    rows = with_fingerprint(docs.select(F.col(key).alias("k"), F.col(text).alias("x")), "x", width, "p")
    rows = written(rows.select("k", F.xxhash64("x").alias("h"), "p"), "fingerprints")
    classes = written(rows.groupBy("p").agg(F.min("k").alias("k")), "classes")
    found = components(forest(classes.select("p"), max_bits))
    grouped = classes.join(found.select(F.col("node").alias("p"), F.col("component").alias("root")), "p", "left")
    grouped = written(grouped, "grouped")
    linked = grouped.where("root IS NOT NULL")
    names = written(linked.groupBy("root").agg(F.min("k").alias("name")), "names")
    named = matched(linked, names, "root").select("p", "name")
    named = written(named.unionAll(grouped.where("root IS NULL").select("p", F.col("k").alias("name"))), "named")
    return rows.join(named, "p")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (bigint) and ``component_id``.

    ``component_id`` is the smallest key reachable over fingerprint links, the
    row's own included.  Rows with equal fingerprints are one class, so copies
    are never paired; links join classes.  NULL, empty and wordless texts have
    fingerprint 0 and are linked like any other.  NULL keys belong to their
    class but never name it unless its component has no other key (then
    ``component_id`` is NULL).  Repeated keys give one row each.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    out = _classified(docs, key, text, width, max_bits)
    return out.select(F.col("k").alias(key), F.col("p").alias("fingerprint"), F.col("name").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, sent: int = SENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one whose key names it.

    Rows with a NULL key stay only if no row of their component has a key.
    Repeated rows (key and text alike) are one document and stay or go
    together.  The rows that go are counted first: up to ``sent`` of their
    (key, text hash) pairs are broadcast, so the texts are not shuffled; more
    are joined by a shuffle.
    """
    gone = _classified(docs, key, text, width, max_bits).where(~F.col("k").eqNullSafe(F.col("name"))).select("k", "h").distinct()
    k, h = free_name(docs, "gone_key"), free_name(docs, "gone_text")
    gone = written(gone.select(F.col("k").alias(k), F.col("h").alias(h)), "gone")
    few = gone.limit(sent + 1).count() <= sent
    same = docs[key].eqNullSafe(gone[k]) & (F.xxhash64(docs[text]) == gone[h])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
