"""Passages that several texts share, to the word: verbatim spans, and near copies of lines and of parts of lines."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import discard, matched, settled, whole
from crosstide.llm.paragraphs import ALIKE, CUT, PASSAGE, SHORT, WIDTH, _runs, _shared
from crosstide.llm.words import ODD, Words, grams, least, ranges, stretch, sums, taken, words

#: Rows with candidate places that are broadcast to the texts; more are joined by a shuffle.
SENT = 200_000
#: Number from which parts of lines are counted; no text has as many lines.
PARTS = 1 << 30


def chosen(found: Words, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(running sums, text, first word, chosen word) of every ``passage`` words in a row: there begins the half as long gram with the smallest hash.

    Equal passages choose equal grams, whatever stands round them.
    """
    half = max(1, passage // 2)
    run = sums(found.hashes)
    at = least(grams(run, half), passage - half + 1)
    counts = np.maximum(np.diff(found.first) - passage + 1, 0)
    begin = ranges(found.first[:-1], counts)
    return run, np.repeat(np.arange(len(counts)), counts), begin, at[begin]


def _batches(made: Iterator[list], names: list[str], types: list, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at least ``size`` rows (the last may be smaller) from lists of columns."""
    held, n = [], 0
    for columns in made:
        held.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names))
        n += held[-1].num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _prints(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch, texts in taken(batches, 1):
                found = words(texts)
                run, text, _, at = chosen(found, passage)
                new = np.flatnonzero(np.diff(at, prepend=-1))
                text, at = text[new], at[new]
                yield batch.column(0).to_numpy()[text], at - found.first[text], stretch(run, at, at + max(1, passage // 2)).view(np.int64)

        yield from _batches(made(), ["row", "at", "f"], [pa.int64(), pa.int32(), pa.int64()])

    return run


def _windows(passage: int):
    """Every ``passage`` words whose chosen gram is one of the row's given ones, those with one gram in a row: the gram, a hash
    of all words and of where the gram stands in them, first word; of each window, hash and place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch, texts in taken(batches, 1):
                found = words(texts)
                run, text, w, at = chosen(found, passage)
                given = np.zeros(len(found.hashes) + 1, dtype=bool)
                spots = batch.column(2)
                given[np.repeat(found.first[:-1], spots.value_lengths().to_numpy()) + spots.flatten().to_numpy()] = True
                i = np.flatnonzero(given[at])
                text, w, at = text[i], w[i], at[i]
                begin = found.begin[text]
                g = stretch(run, w, w + passage).view(np.int64)
                new = np.flatnonzero(np.diff(at, prepend=-1))
                offsets = pa.array(np.append(new, len(at)), pa.int32())
                first, last, at, text = w[new], w[np.append(new[1:], len(at))[: len(new)] - 1], at[new], text[new]
                f = stretch(run, at, at + max(1, passage // 2))
                every = stretch(run, first, last + passage) + f * np.uint64(ODD) + (at - first).astype(np.uint64)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((g, pa.int64()), (found.start[w] - begin, pa.int32()), (found.end[w + passage - 1] - begin, pa.int32()))]
                yield batch.column(0).to_numpy()[text], first - found.first[text], f.view(np.int64), every.view(np.int64), *lists

        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2]
        yield from _batches(made(), ["place", "w", "f", "every", "g", "start", "end"], types, 10_000)

    return run


def _spans(passage: int):
    """Overlapping windows of a place as one span, with the first words of the windows that have their first place here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for rows in whole(batches, 1):
                place, w, n, cluster, start, end, low = (rows[c].to_numpy() for c in ("place", "w", "n", "cluster", "start", "end", "low"))
                new = np.ones(len(place), dtype=bool)
                new[1:] = (place[1:] != place[:-1]) | (w[1:] >= w[:-1] + n[:-1] - 1 + passage)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(place)) - 1
                own = np.flatnonzero(low == place)
                lists = rows["g"].combine_chunks().take(pa.array(own))
                g, own, at = lists.flatten().to_numpy(), np.repeat(own, n[own]), ranges(w[own].astype(np.int64), n[own])
                # A window that stands twice in its first place counts once there.
                order = np.lexsort((at, g, place[own]))
                once = np.ones(len(order), dtype=bool)
                once[1:] = (g[order[1:]] != g[order[:-1]]) | (place[own[order[1:]]] != place[own[order[:-1]]])
                kept = np.sort(order[once])
                firsts = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[kept], np.append(a, len(place))), pa.int32()), pa.array(at[kept], pa.int32()))
                yield place[a], w[a], w[b] + n[b] - 1 + passage - w[a], start[a], end[b], cluster[a], low[a], firsts

        names = ["place", "w", "n_words", "start", "end", "cluster", "low", "firsts"]
        yield from _batches(made(), names, [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.list_(pa.int32())], 10_000)

    return run


def verbatim(numbered: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The spans of ``passage`` words or more, all of whose words lie in ``passage`` words that another row has too.

    ``numbered`` has a key ``k``, a number ``row`` and a text ``x``.  Every such
    span is found, to the word: of each ``passage`` words one gram is looked up,
    and round the grams of several rows all windows are compared by hash.  No
    step lists pairs.
    """
    prints = numbered.select("row", "x").mapInArrow(_prints(passage), "row long, at int, f long")
    prints = settled(prints, "prints")
    known = settled(prints.groupBy("f").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("f"), "known")
    spots = settled(matched(prints, known, "f").groupBy("row").agg(F.collect_list("at").alias("spots")), "spots")
    discard(prints)
    discard(known)
    keys = matched(numbered.select("k", "row"), spots.select("row"), "row")
    # Numbers in the order of the keys, so the smallest is the first place.
    places = settled(keys.orderBy("k", "row").withColumn("place", F.monotonically_increasing_id()), "places")
    asked = matched(numbered.select("row", "x"), spots.join(places.select("row", "place"), "row"), "row", sent=SENT)
    kinds = "place long, w int, f long, every long, g array<long>, start array<int>, end array<int>"
    windows = settled(asked.select("place", "x", "spots").mapInArrow(_windows(passage), kinds), "windows")
    # Where all windows round a gram are the same in every place they are shared as one; else each is looked up.
    around = [F.min("place").alias("low"), F.max("place").alias("high"), F.min("every").alias("least"), F.max("every").alias("most")]
    around = settled(windows.groupBy("f").agg(*around).select("f", F.expr("if(least = most, low, NULL)").alias("low")), "windows-around")
    windows_of = matched(windows.drop("every"), around, "f")
    single = windows_of.where("low IS NULL").select("place", F.posexplode(F.arrays_zip("g", "start", "end")).alias("i", "x"), "w")
    single = settled(single.select("place", (F.col("w") + F.col("i")).alias("w"), "x.*"), "windows-single")
    shared = single.groupBy("g").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("g", "low")
    shared = settled(shared, "windows-shared")
    own = "if(low = place, {}, NULL) AS g"
    alone = matched(single, shared, "g").selectExpr("place", "w", "1 AS n", "g AS cluster", "start", "end", "low", own.format("array(g)"))
    together = windows_of.where("low IS NOT NULL").selectExpr("place", "w", "size(g) AS n", "g[0] AS cluster", "start[0] AS start", "end[size(end) - 1] AS end", "low", own.format("g"))
    met = alone.unionAll(together).repartition("place").sortWithinPartitions("place", "w")
    spans = met.mapInArrow(_spans(passage), "place long, w int, n_words int, start int, end int, cluster long, low long, firsts array<int>")
    spans = settled(spans, "spans")
    for done in (windows, around, single, shared, spots):
        discard(done)
    spans = matched(spans, places, "place")
    spans = matched(spans, places.select(F.col("place").alias("low"), F.col("k").alias("kept_in")), "low")
    return spans.select("row", "k", "w", "n_words", "start", "end", "cluster", "kept_in", "firsts")


class Units(NamedTuple):
    """Lines and parts of lines: text, number, first word of it and the one after the last, place in the text, and the segments (of ``least``) they are made of: from, to (the last)."""

    text: np.ndarray
    p: np.ndarray
    a: np.ndarray
    b: np.ndarray
    start: np.ndarray
    end: np.ndarray
    head: np.ndarray
    tail: np.ndarray


def units(found: Words, width: int, passage: int = PASSAGE) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of texts, numbered from 0, and parts of them, numbered from PARTS, so that of a row's places the line is the first; running sums, and the segments between content cuts: first word, the one after the last.

    A line is cut where the hash of the ``width`` words before is a multiple of
    CUT, at least SHORT words after the last cut and before the line's end.  A
    part begins at a cut or with the line, and ends at the first cut or line end
    that makes it ``passage`` words long, so parts overlap.  Lines of fewer than ``width`` words have no segment.
    """
    run = sums(found.hashes)
    ends_line = np.ones(len(found.codes) + 2, dtype=bool)
    ends_line[1:-1] = (found.codes == 10) | (found.codes == 13)
    edge = np.flatnonzero(ends_line[1:] != ends_line[:-1])
    opens, closes = edge[::2], edge[1::2]
    line = np.searchsorted(opens, found.start, "right") - 1
    a = np.flatnonzero(np.diff(line, prepend=-1))
    b = np.append(a[1:], len(line))[: len(a)]
    line = line[a]
    text = np.searchsorted(found.begin, opens[line], "right") - 1
    p = line - np.searchsorted(opens, found.begin)[text]

    # The cuts, among one word in CUT.
    short = max(SHORT, width)
    likely = np.flatnonzero(grams(run, width) % np.uint64(CUT) == 0) + width
    owner = np.searchsorted(a, likely - width, "right") - 1
    fits = (likely - a[owner] >= short) & (b[owner] - likely >= short)
    cuts, kept, last, stands = [], [], -1, 0
    for at, i in zip(likely[fits].tolist(), owner[fits].tolist(), strict=True):
        if i != last or at - stands >= short:
            cuts.append(at)
            kept.append(i)
            last, stands = i, at
    cut, of = np.array(cuts, dtype=np.int64), np.array(kept, dtype=np.int64)

    long = np.flatnonzero(b - a >= width)
    begins = np.sort(np.concatenate([a[long], cut]))
    begins_of = np.searchsorted(a, begins, "right") - 1
    ends = np.sort(np.concatenate([cut, b[long]]))
    # A part takes the segments from its own to the first that ends late enough, if that is of the same line.
    head = np.arange(len(begins))
    tail = np.searchsorted(ends, begins + passage)
    some = tail < len(ends)
    some[some] = (begins_of[tail[some]] == begins_of[some]) & (ends[tail[some]] - begins[some] < (b - a)[begins_of[some]])
    head, tail = head[some], tail[some]
    part_text = text[begins_of[head]]
    number = np.arange(len(head)) - np.searchsorted(part_text, part_text) + 1

    none = np.full(len(a), -1)
    line_head, line_tail = none.copy(), none
    line_head[long] = np.searchsorted(begins, a[long])
    line_tail[long] = np.searchsorted(ends, b[long])
    out = Units(
        np.concatenate([text, part_text]),
        np.concatenate([p, PARTS + number]),
        np.concatenate([a, begins[head]]),
        np.concatenate([b, ends[tail]]),
        np.concatenate([opens[line], found.start[begins[head]]]),
        np.concatenate([closes[line], found.end[ends[tail] - 1]]),
        np.concatenate([line_head, head]),
        np.concatenate([line_tail, tail]),
    )
    return out, run, begins, ends


def _split(width: int, bands: int, rows: int, passage: int):
    """``units`` of each text: place, words, hash, text, band keys.

    The smallest hashes are taken over each segment once, whole and without the
    shingles that reach into the next; a unit's are the smallest of its segments'.
    """
    deal = np.random.default_rng(23)
    mix = deal.integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
    names = ["k", "row", "p", "w", "start", "end", "n", "h", "line", "bands"]

    def smallest(g: np.ndarray, u: Units, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By unit with a segment and hash function."""
        pairs = np.stack([begins, ends - width + 1], axis=1).reshape(-1)
        pairs = np.minimum(pairs, len(g))  # the last segment may end with the hashes
        g = np.append(g, np.uint64(0))
        low = np.empty((2 * len(begins), len(mix)), dtype=np.uint64)
        x = np.empty_like(g)
        for i, m in enumerate(mix):
            np.multiply(g, m, out=x)
            by = np.minimum.reduceat(x, pairs)
            low[0::2, i] = np.minimum(by[0::2], by[1::2]) if width > 1 else by[0::2]
            low[1::2, i] = by[0::2]
        # All segments but the last whole: even rows, then the odd one of the last.
        lengths = u.tail - u.head + 1
        at = 2 * ranges(u.head, lengths)
        at[np.cumsum(lengths) - 1] += 1
        return np.minimum.reduceat(low[at], np.cumsum(lengths) - lengths, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in taken(batches, 2):
            found = words(texts)
            u, run, begins, ends = units(found, width, passage)
            if not len(u.text):
                continue
            several = u.b - u.a > width  # one shingle has no similar one but its equal
            keys = np.empty((int(several.sum()), bands), dtype=np.uint64)
            if len(keys):
                low = smallest(grams(run, width), Units(*(x[several] for x in u)), begins, ends)
                for b in range(bands):
                    key = np.full(len(keys), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        key = (key ^ low[:, b * rows + r]) * np.uint64(0xC2B2AE3D27D4EB4F)
                        key ^= key >> np.uint64(29)
                    keys[:, b] = key
            offsets = pa.array(np.concatenate([[0], np.cumsum(several * bands)]).astype(np.int32))
            begin = found.begin[u.text]
            start, end = u.start - begin, u.end - begin
            columns = [
                batch.column(0).take(pa.array(u.text)),
                batch.column(1).take(pa.array(u.text)),
                *(pa.array(x.astype(np.int32)) for x in (u.p, u.a - found.first[u.text], start, end, u.b - u.a)),
                pa.array(stretch(run, u.a, u.b).view(np.int64)),
                pa.array([texts[t][a:b] for t, a, b in zip(u.text.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _shingles(width: int):
    """The shingles of a row's given places: number and cluster of the place, first word, hash, place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch, texts in taken(batches, 1):
                found = words(texts)
                run = sums(found.hashes)
                places = batch.column(2)
                text = np.repeat(np.arange(len(texts)), places.value_lengths().to_numpy())
                p, c, w, n = (places.flatten().field(x).to_numpy() for x in ("p", "c", "w", "n"))
                counts = n.astype(np.int64) - width + 1
                i = ranges(found.first[text] + w, counts)
                text, p, c = (np.repeat(x, counts) for x in (text, p, c))
                begin = found.begin[text]
                s = stretch(run, i, i + width).view(np.int64)
                yield batch.column(0).to_numpy()[text], p, c, i - found.first[text], s, found.start[i] - begin, found.end[i + width - 1] - begin

        names = ["row", "p", "c", "w", "s", "start", "end"]
        yield from _batches(made(), names, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()])

    return run


def _parts(numbered: DataFrame, marked: DataFrame, exact: DataFrame, width: int) -> DataFrame:
    """The near copied parts of lines, cut to the first and last shingle that their cluster has in another row too.

    Parts half of whose words lie in verbatim spans are left to those.
    """
    spans = exact.groupBy("row").agg(F.collect_list(F.struct("w", "n_words")).alias("spans"))
    parts = matched(marked.where(F.col("p") >= PARTS), settled(spans, "spans-of-rows"), "row", "left", SENT)
    inside = "aggregate(coalesce(spans, array()), 0L, (a, s) -> a + greatest(0L, least(w + n, s.w + s.n_words) - greatest(w, s.w)))"
    parts = settled(parts.where(f"2 * {inside} < n").drop("spans"), "parts")
    members = marked.join(parts.select("c").distinct(), "c", "left_semi").where(F.col("n") >= width)
    members = members.groupBy("row").agg(F.collect_list(F.struct("p", "c", "w", "n")).alias("places"))
    asked = matched(numbered.select("row", "x"), settled(members, "members"), "row", sent=SENT)
    held = settled(asked.mapInArrow(_shingles(width), "row long, p int, c long, w int, s long, start int, end int"), "shingles")
    shared = held.groupBy("c", "s").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("c", "s")
    ends = held.where(F.col("p") >= PARTS).join(shared, ["c", "s"]).groupBy("row", "p")
    ends = ends.agg(F.min("w").alias("w"), (F.max("w") - F.min("w") + width).cast("long").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"))
    return parts.select("row", "p", "k", F.col("c").alias("cluster"), "first").join(ends, ["row", "p"])


def _merged(passage: int):
    """Overlapping spans of a row as one; it stays if a first place stays that no near copy of an earlier place covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def made():
            for rows in whole(batches, 1):
                types[:] = types or [rows[c].type for c in ("k", "start", "end", "n_words", "cluster", "kept_in")] + [pa.bool_()]
                row = rows["row"].to_numpy()
                edge = np.flatnonzero(np.diff(row, prepend=row[0] - 1, append=row[-1] - 1)).tolist()
                w, n = rows["w"].to_numpy(), rows["n_words"].to_numpy()
                ends, w = (w + n).tolist(), w.tolist()
                stays = rows["stays"].to_pylist()
                firsts = rows["firsts"].combine_chunks()
                near = firsts.is_null().to_numpy(zero_copy_only=False).tolist()
                some = pc.fill_null(pc.list_value_length(firsts), 0).to_numpy()
                upto = np.cumsum(some)
                first, last, windows = (upto - some).tolist(), upto.tolist(), firsts.flatten().to_numpy()
                opens: list[int] = []  # of each merged span, its first row, the row it ends with, its words, and whether it stays
                closes: list[int] = []
                sizes: list[int] = []
                kept: list[bool] = []
                for a, b in pairwise(edge):
                    begins, reach, exact = [], [], []
                    for x in range(a, b):
                        if near[x]:
                            begins.append(w[x])
                            reach.append(max(ends[x], reach[-1] if reach else 0))
                        else:
                            exact.append(x)
                    starts = [w[x] for x in exact]
                    covered = np.array([0, *reach])
                    at = 0
                    for x in range(a, b):
                        left = stays[x]
                        if left:  # all words of this first near copy may stand verbatim in earlier places
                            i = bisect_right(starts, w[x]) - 1
                            if i >= 0 and ends[exact[i]] >= ends[x]:
                                own = windows[first[exact[i]] : last[exact[i]]]
                                left = bool(((own >= w[x]) & (own <= ends[x] - passage)).any())
                        if not left and last[x] > first[x]:
                            if begins:
                                own = windows[first[x] : last[x]]
                                before = np.searchsorted(begins, own, "right")
                                left = bool(((before == 0) | (covered[before] < own + passage)).any())
                            else:
                                left = True
                        if x > a and w[x] < at:
                            if ends[x] > at:
                                closes[-1], sizes[-1], at = x, sizes[-1] + ends[x] - at, ends[x]
                            kept[-1] = kept[-1] or left
                        else:
                            opens.append(x)
                            closes.append(x)
                            sizes.append(ends[x] - w[x])
                            kept.append(left)
                            at = ends[x]
                of, to = pa.array(opens, pa.int64()), pa.array(closes, pa.int64())
                k, start, cluster, kept_in = (rows[c].combine_chunks().take(of) for c in ("k", "start", "cluster", "kept_in"))
                yield k, start, rows["end"].combine_chunks().take(to), sizes, cluster, kept_in, [not x for x in kept]

        yield from _batches(made(), ["k", "start", "end", "n_words", "cluster", "kept_in", "removed"], types, 10_000)

    return run


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, alike: float = ALIKE, passage: int = PASSAGE) -> DataFrame:
    """The passages of ``passage`` words or more that occur in several rows of ``docs``, one row for each place.

    Columns: ``key``, ``start`` and ``end`` (code points of the text), ``n_words``,
    ``cluster``, ``kept_in`` (the smallest key that has its first part) and ``removed``.  Words are
    lower-cased and end at white space.  A passage is the union of overlapping

    * verbatim spans: every one of ``verbatim``, wherever it begins, ends or breaks into lines;
    * near copies: lines, and overlapping parts of lines (``units``), whose
      shingle sets have a Jaccard similarity of ``alike`` or more, found with
      probability 0.99 or more at ``alike``, or through others, the parts cut
      to the first and last shingle shared with another row; and
      several such lines in a row, where both neighbours repeat together.

    Each has ``passage`` words or more by itself.  The first place of each stays:
    a passage is removed if it holds no first place; first places of verbatim
    windows inside a near copy follow the near copy, and a first near copy inside a
    verbatim span follows the windows.
    Repeats inside one row alone do not count.  Whole texts are read; NULL,
    empty and blank ones have no passage.  Repeated rows of a document are
    occurrences of their own; NULL keys take part and come first.  Other
    columns are ignored.
    """
    numbered = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("x"))
    numbered = settled(numbered, "texts")
    exact = verbatim(numbered, passage).withColumn("stays", F.lit(False)).withColumn("n_words", F.col("n_words").cast("long"))
    marked = settled(_shared(numbered, width, alike, partial(_split, passage=passage)), "units")
    parts = _parts(numbered, marked, exact, width).withColumn("stays", F.struct("k", "row", "p").eqNullSafe(F.col("first"))).drop("p")
    near = _runs(marked.where(F.col("p") < PARTS)).unionByName(parts).where(F.col("n_words") >= passage)
    near = near.withColumn("kept_in", F.col("first.k")).withColumn("firsts", F.lit(None).cast("array<int>")).drop("first")
    kind = dict(numbered.dtypes)["k"]
    names = ["row", "k", "w", "n_words", "start", "end", "cluster", "kept_in", "firsts", "stays"]
    spans = near.select(*names).unionAll(exact.select(*names)).repartition("row").sortWithinPartitions("row", "w", F.desc("n_words"))
    out = spans.mapInArrow(_merged(passage), f"k {kind}, start int, end int, n_words long, cluster long, kept_in {kind}, removed boolean")
    return out.withColumnRenamed("k", key)
