"""Repeated passages by MinHash banding of paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import components, discard, matched, settled, whole
from crosstide.llm.words import TAKEN, ranges, stretch, sums, words

#: Words of a shingle, similarity of a repeat, words of a passage.
WIDTH, ALIKE, PASSAGE = 5, 0.8, 50
#: Paragraphs of a band key that are compared in one block.
BLOCK = 500
#: Fewer paragraphs are compared one by one; of more, all at once, so many cells of a matrix at a time.
FEW, HELD = 8, 4_000_000
#: A paragraph inside a line ends at one word in CUT, and has SHORT words at least.
CUT, SHORT = 16, 8
LINE = re.compile(r"[^\r\n]+")
WORD = re.compile(r"\S+")


def tuned(alike: float = ALIKE, recall: float = 0.99, noise: float = 1e-3) -> tuple[int, int]:
    """(bands, rows): the fewest bands that bring a pair at ``alike`` together with probability ``recall``
    and a pair that shares a shingle in twenty with at most ``noise``."""
    for bands in range(1, 200):
        for rows in range(12, 0, -1):
            if 1 - (1 - alike**rows) ** bands >= recall and 1 - (1 - 0.05**rows) ** bands <= noise:
                return bands, rows
    raise ValueError("no banding is that sharp")


def shingles(words: list[str], width: int = WIDTH) -> set[str]:
    """The distinct shingles; fewer words are one shingle."""
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a: str, b: str, width: int = WIDTH) -> float:
    """Exact similarity of the shingle sets of two paragraphs."""
    x, y = shingles(a.lower().split(), width), shingles(b.lower().split(), width)
    return len(x & y) / len(x | y)


def _cut(words: list[str], width: int) -> tuple[list[int], list[int]]:
    """The shingle hashes of a line, and the words at which its paragraphs begin."""
    digest = xxhash.xxh64_intdigest
    data = " ".join(words).encode("utf-8", "surrogatepass")
    ends, at = [], -1
    for w in words if data.isascii() else (w.encode("utf-8", "surrogatepass") for w in words):
        at += len(w) + 1
        ends.append(at)
    n, k = len(words), min(width, len(words))
    starts = [0, *[e + 1 for e in ends[: n - k]]]
    hashes = [digest(data[a:b]) for a, b in zip(starts, ends[k - 1 :], strict=True)]
    cuts = [0]
    for i, h in enumerate(hashes):
        if h % CUT == 0 and i + k - cuts[-1] >= SHORT and n - i - k >= SHORT:
            cuts.append(i + k)
    return hashes, cuts


def paragraphs(text: str | None, width: int = WIDTH) -> list[tuple[int, int, list[str], list[int]]]:
    """(start, end, words, shingle hashes) of a text's paragraphs, in order.

    A line ends a paragraph.  Inside a line one ends where the hash of the
    ``width`` words before is a multiple of CUT, at least SHORT words after
    the last end and before the line's end.  So the same passage is cut at the
    same words whatever stands round it, wherever its lines break.  Words are
    lower-cased; a paragraph of fewer than ``width`` words is one shingle.
    """
    out = []
    for m in LINE.finditer(text or ""):
        words = m[0].lower().split()
        if not words:
            continue
        hashes, cuts = _cut(words, width)
        n, k = len(words), min(width, len(words))
        if len(cuts) == 1:
            out.append((m.start(), m.end(), words, hashes))
            continue
        spans = [w.span() for w in WORD.finditer(m[0])]
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            out.append((m.start() + spans[a][0], m.start() + spans[b - 1][1], words[a:b], hashes[a : b - k + 1]))
    return out


def _numbered(text: str | None, width: int) -> Iterator[tuple]:
    """The paragraphs, each with its number and no word offset."""
    for p, part in enumerate(paragraphs(text, width)):
        yield *part, 0, p


def _split(width: int, bands: int, rows: int):
    """Paragraphs of each text: place, words, hash of the normalised paragraph, that paragraph, band keys."""
    deal = np.random.default_rng(23)
    mix = deal.integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
    names = ["k", "row", "p", "w", "start", "end", "n", "h", "line", "bands"]

    def batch_of(held: list[tuple], hashes: list[list[int]], types: list) -> pa.RecordBatch:
        h = np.array([x for one in hashes for x in one], dtype=np.uint64)
        lengths = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
        first = np.cumsum(lengths) - lengths
        least = np.empty((len(hashes), bands * rows), dtype=np.uint64)
        for i, m in enumerate(mix):
            x = h * m
            x ^= x >> np.uint64(32)
            least[:, i] = np.minimum.reduceat(x * np.uint64(0x9E3779B97F4A7C15), first)
        keys = np.empty((len(hashes), bands), dtype=np.uint64)
        for b in range(bands):
            key = np.full(len(hashes), b + 1, dtype=np.uint64)
            for r in range(rows):
                key = (key ^ least[:, b * rows + r]) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(29)
            keys[:, b] = key
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
        several = lengths > 1  # one shingle has no similar one but its equal
        offsets = pa.array(np.concatenate([[0], np.cumsum(several * bands)]).astype(np.int32))
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(keys[several].reshape(-1).view(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.column(0).type, pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.string()]
            held: list[tuple] = []
            hashes: list[list[int]] = []
            size = 0
            for key, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                key, row = key.as_py(), row.as_py()
                for start, end, words, own, w, p in _numbered(text.as_py(), width):
                    line = " ".join(words)
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 7)
                    held.append((key, row, p, w, start, end, len(words), h - (1 << 64) if h >> 63 else h, line))
                    hashes.append(own)
                    size += len(own)
                    if size > 200_000:
                        yield batch_of(held, hashes, types)
                        held, hashes, size = [], [], 0
            if held:
                yield batch_of(held, hashes, types)

    return run


def _sets(lines: list[str], width: int) -> list[set[int]]:
    """The hashes of the distinct shingles of each paragraph."""
    out: list[set[int]] = []
    sizes = np.cumsum([len(x) for x in lines]) // TAKEN
    for a, b in pairwise([*np.flatnonzero(np.diff(sizes, prepend=-1)).tolist(), len(lines)]):
        found = words(lines[a:b])
        run = sums(found.hashes)
        n = np.diff(found.first)
        counts = np.maximum(n - width + 1, 1)
        at = ranges(found.first[:-1], counts)
        g = stretch(run, at, at + np.repeat(np.minimum(n, width), counts)).tolist()
        ends = np.cumsum(counts).tolist()
        out += [set(g[i:j]) for i, j in pairwise([0, *ends])]
    return out


def _alike(a: Column, b: Column, width: int, least: float) -> Column:
    @F.pandas_udf("boolean")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        sets = _sets([*left, *right], width)
        out = []
        for x, y in zip(sets[: len(left)], sets[len(left) :], strict=True):
            small, large = sorted((len(x), len(y)))
            both = len(x & y) if small / large >= least else 0
            out.append(both / (small + large - both) >= least)
        return pd.Series(out, dtype=bool)

    return of(a, b)


def similar(lines: DataFrame, width: int = WIDTH, alike: float = ALIKE) -> DataFrame:
    """(h, cluster) of the paragraphs that have a different, similar one in another row; from (h, row, line, bands).

    Each band key with several different paragraphs first compares all with the
    smallest.  Groups joined by that are taken as one: a key whose paragraphs
    are all in one group is done, the others compare across their groups only,
    in blocks of BLOCK paragraphs that return one link per group joined.  So no
    step lists the pairs of a key, and no task holds more than two blocks.
    Paragraphs that one row alone has are no repeat of each other and not linked.
    """
    keyed = lines.select("h", "row", F.explode("bands").alias("key"))
    met = [F.min("h").alias("m"), F.max("h").alias("x"), F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("n")]
    # Overlapping parts of one text are alike and no repeat of each other.
    buckets = keyed.groupBy("key").agg(*met).where("m < x AND low < high").select("key", "m", "x", "n")
    buckets = settled(buckets, "buckets")
    # Two entries are known by now; only keys with more are looked up again.
    two = buckets.where("n = 2").select("key", F.explode(F.array("m", "x")).alias("h"), "m")
    more = matched(keyed, buckets.where("n > 2").select("key", "m"), "key").select("key", "h", "m").distinct()
    hits = settled(two.unionAll(more), "hits")
    asked = settled(hits.select("h").distinct(), "asked")
    texts = matched(lines.select("h", "row", "line"), asked, "h")
    texts = texts.groupBy("h").agg(F.any_value("line").alias("line"), F.min("row").alias("low"), F.max("row").alias("high"))
    # The row of a paragraph that no other row has.
    texts = settled(texts.select("h", "line", F.expr("if(low = high, low, NULL)").alias("only")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("h").alias("u"), F.col("line").alias("a"), F.col("only").alias("i"))
        right = texts.select(F.col("h").alias("v"), F.col("line").alias("b"), F.col("only").alias("j"))
        both = pairs.join(left, "u").join(right, "v").where("NOT coalesce(i = j, false)")
        return both.where(_alike(F.col("a"), F.col("b"), width, alike)).select("u", "v")

    stars = hits.where("h <> m").select(F.col("h").alias("u"), F.col("m").alias("v")).distinct()
    near = settled(verified(stars), "stars")
    group = components(near).select(F.col("node").alias("h"), F.col("component").alias("g"))
    labelled = settled(hits.join(group, "h", "left").select("key", "h", "m", F.coalesce("g", "h").alias("g")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("key")
    open_ = settled(labelled.join(mixed, "key", "left_semi"), "mixed")
    crowded = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    parts = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    dealt = open_.join(crowded, "key", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    paired = dealt.select("key", "h", "g", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = paired.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "h", "g")
    blocks = paired.join(texts, "h").select("key", "low", "high", "part", "h", "g", F.coalesce("only", F.lit(-1)).alias("only"), "line")
    met = blocks.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "h").mapInArrow(_met(width, alike), "u long, v long")
    out = settled(components(settled(near.unionAll(met), "links")).select(F.col("node").alias("h"), F.col("component").alias("cluster")), "clusters")
    for done in (buckets, hits, asked, texts, near, labelled, open_):
        discard(done)
    return out


def _common(sets: list[set[int]]) -> np.ndarray:
    """How many elements every two sets have in common."""
    n = len(sets)
    name, column = np.unique(np.fromiter((x for one in sets for x in one), dtype=np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    often = np.bincount(column, minlength=len(name)) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[column]
    out = np.zeros((n, n), dtype=np.float32)
    many = int(often.sum())
    wide = max(1, min(HELD // n, many))
    for a in range(0, many, wide):
        some = (column >= a) & (column < a + wide)
        has = np.zeros((n, wide), dtype=np.float32)
        has[owner[some], column[some] - a] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _met(width: int, least: float):
    """Links between paragraphs of one or two blocks of a band key, as a forest over their groups."""

    def links(low: int, high: int, part: list, h: list, group: list, only: list, sets: list[set[int]]) -> Iterator[tuple[int, int]]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        if len(sets) < FEW:
            pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
        else:
            both, sizes = _common(sets), np.array([len(x) for x in sets])
            i, j = np.nonzero(np.tril(both / (sizes[:, None] + sizes - both) >= least, -1))
            pairs = zip(i.tolist(), j.tolist(), strict=True)
        for i, j in pairs:
            if low != high and part[i] == part[j] or only[i] == only[j] >= 0 or (a := top(group[i])) == (b := top(group[j])):
                continue
            if len(sets) < FEW:
                small, large = sorted((len(sets[i]), len(sets[j])))
                if small / large < least:
                    continue
                both = len(sets[i] & sets[j])
                if both / (small + large - both) < least:
                    continue
            above[max(a, b)] = min(a, b)
            yield h[i], h[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches, 3):
            keys = [rows[c].to_numpy() for c in ("key", "low", "high")]
            new = np.ones(rows.num_rows + 1, dtype=bool)
            new[1:-1] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            edge = np.flatnonzero(new).tolist()
            low, high, part, h, group, only = (rows[c].to_pylist() for c in ("low", "high", "part", "h", "g", "only"))
            sets = _sets(rows["line"].to_pylist(), width)
            found = [x for a, b in zip(edge[:-1], edge[1:], strict=True) for x in links(low[a], high[a], *(y[a:b] for y in (part, h, group, only, sets)))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, alike: float = ALIKE, passage: int = PASSAGE) -> DataFrame:
    """The passages of about ``passage`` words or more that occur in several rows of ``docs``, one row for each place.

    Columns: ``key``, ``start`` and ``end`` (code points of the text), ``n_words``,
    ``cluster`` (of the first paragraph), ``kept_in`` (the smallest key that has
    it) and ``removed``.  The first place of each cluster stays: a passage is
    removed if it holds the first place of none of its paragraphs.

    Paragraphs are those of ``paragraphs``.  Two repeat each other if the
    Jaccard similarity of their shingle sets (``width`` lower-cased words; a
    shorter paragraph is one shingle) is at least ``alike``, found with
    probability 0.99 or more at ``alike``, or through others; equal ones
    always.  Clusters are connected components.  A passage is one repeated
    paragraph, or several in a row whose neighbourhood also repeats in another
    row.  A passage that begins and ends inside paragraphs leaves fewer whole
    ones, so runs of half ``passage`` words count.
    Repeats inside one row alone do not count.  Whole texts are read;
    NULL, empty and blank ones have no paragraph.  Repeated rows of a document
    are occurrences of their own; NULL keys take part and come first.  Other
    columns are ignored.
    """
    numbered = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("x"))
    out = _runs(_shared(numbered, width, alike)).where(F.col("n_words") >= passage // 2)
    return out.select(F.col("k").alias(key), "start", "end", "n_words", "cluster", F.col("first.k").alias("kept_in"), (~F.col("stays")).alias("removed"))


def _shared(numbered: DataFrame, width: int, alike: float, split=_split) -> DataFrame:
    """Every place of a paragraph that repeats in another row, with its cluster ``c`` and the first place of that."""
    bands, rows = tuned(alike)
    kind = dict(numbered.dtypes)["k"]
    schema = f"k {kind}, row long, p int, w int, start int, end int, n int, h long, line string, bands array<long>"
    lines = settled(numbered.mapInArrow(split(width, bands, rows), schema), "paragraphs")
    near = similar(lines.select("h", "row", "line", "bands"), width, alike)

    seen = lines.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    held = settled(matched(seen, near, "h", "left").where("low < high OR cluster IS NOT NULL"), "held")
    wide = held.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("cluster")
    shared = held.where("cluster IS NULL").select("h", F.col("h").alias("c"))
    shared = settled(shared.unionAll(held.join(wide, "cluster", "left_semi").select("h", F.col("cluster").alias("c"))), "shared")
    marked = settled(matched(lines.select("k", "row", "p", "w", "start", "end", "n", "h"), shared, "h").drop("h"), "marked")
    for done in (lines, near, held, shared):
        discard(done)
    return matched(marked, settled(marked.groupBy("c").agg(F.min(F.struct("k", "row", "p")).alias("first")), "firsts"), "c")


def _runs(marked: DataFrame) -> DataFrame:
    """Repeated paragraphs in a row whose neighbourhood also repeats in another row, as one place."""
    order = Window.partitionBy("row").orderBy("p")
    linked = settled(marked.withColumns({"next": F.lead("c").over(order), "next_p": F.lead("p").over(order)}), "linked")
    chains = linked.where("next_p = p + 1").groupBy("c", "next").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("c", "next", F.lit(True).alias("goes_on"))
    steps = linked.join(chains, ["c", "next"], "left")
    goes_on = F.coalesce(F.col("goes_on") & (F.col("next_p") == F.col("p") + 1), F.lit(False))
    steps = steps.select("k", "row", "p", "w", "start", "end", "n", "c", "first", goes_on.alias("goes_on"))
    begins = F.when(F.lag("goes_on").over(order), 0).otherwise(1)
    runs = steps.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    lead = F.struct("p", "c", "first")
    out = runs.groupBy("row", "run").agg(
        F.min("k").alias("k"), F.min("w").alias("w"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_words"), F.min(lead).alias("lead"),
        F.max(F.struct("k", "row", "p").eqNullSafe(F.col("first"))).alias("stays"),
    )
    return out.select("k", "row", "w", "start", "end", "n_words", F.col("lead.c").alias("cluster"), F.col("lead.first").alias("first"), "stays")
