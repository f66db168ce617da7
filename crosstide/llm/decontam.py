"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces: a passage
within k edits leaves at least one piece untouched.  Exact hits of pieces are
found with one automaton, and Myers' bit-parallel distance verifies the text
round them.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item (normalised).
ERRORS = 0.1
#: Characters of test items that are searched for in one pass over the documents.
PASS_CHARS = 8_000_000

#: Length of the letter runs counted before a distance is computed.
RUN = 5

MATCH = "array<struct<item:string,distance:int,start:int,end:int>>"


def normalised(text: str | None) -> str:
    """Lower case, every run of white space one space, trimmed."""
    return " ".join((text or "").lower().split())


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): ``item`` cut into k + 1 pieces of nearly equal length."""
    n = len(item)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def letters_of(item: str) -> dict[str, int]:
    """For each letter the positions where the item has it, as bits."""
    table: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        table[c] |= 1 << i
    return dict(table)


def myers(table: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to an item of ``m`` letters.

    Bit-parallel dynamic programming: one step per letter of the text.  The
    first end wins a tie.  An item of no letters is at distance 0 of nothing.
    """
    full, top = (1 << m) - 1, 1 << (m - 1) if m else 0
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = table.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = (down | ~(d0 | up)) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Item:
    key: str
    text: str
    k: int
    table: dict[str, int]
    runs: list[str]

    @property
    def kept(self) -> int:
        """How many of the runs k edits leave whole at least: they lie apart, so an edit touches one."""
        return len(self.runs) - self.k


def _runs(starts: list[int], width: int) -> Iterator[tuple[int, int]]:
    """(first, last) of groups of ascending numbers, each at most ``width`` wide."""
    first = last = starts[0]
    for s in starts[1:]:
        if s - first > width:
            yield first, last
            first = s
        last = s
    yield first, last


class Searcher:
    """Finds every item of a list in texts, each within its own budget."""

    def __init__(self, items: list[tuple[str, str]], errors: float) -> None:
        self.items: list[Item] = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            if not text:
                continue
            k = budget(len(text), errors)
            for offset, piece in pieces(text, k):
                found[piece].append((len(self.items), offset))
            runs = [text[i : i + RUN] for i in range(0, len(text) - RUN + 1, RUN)]
            self.items.append(Item(key, text, k, letters_of(text), runs))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def windows(self, text: str) -> Iterator[tuple[Item, list[tuple[int, int]]]]:
        """For each item with a piece hit, the stretches of ``text`` that any match with such a hit lies in.

        Stretches that share too few letter runs with the item for its budget
        (a lower bound, so nothing is lost) are left out before verifying.
        """
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                starts[item].add(last + 1 - size - offset)
        for number, at in sorted(starts.items()):
            item = self.items[number]
            spans: list[tuple[int, int]] = []
            for low, high in _runs(sorted(at), item.k):
                a, b = max(0, low - item.k), min(len(text), high + len(item.text) + item.k)
                if sum(map(text[a:b].__contains__, item.runs)) < item.kept:
                    continue
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            if spans:
                yield item, spans

    def search(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(item, distance, start, end) of the nearest match of each item found, in normalised characters."""
        if self.empty:
            return []
        plain, out = normalised(text), []
        for item, spans in self.windows(plain):
            best = (item.k + 1, 0)
            for a, b in spans:
                if best[0] == 0:
                    break
                exact = plain.find(item.text, a, b)
                here = (0, exact + len(item.text)) if exact >= 0 else myers(item.table, len(item.text), plain[a:b])
                if exact < 0:
                    here = (here[0], a + here[1])
                best = min(best, here, key=lambda x: x[0])
            if best[0] <= item.k:
                back = myers(letters_of(item.text[::-1]), len(item.text), plain[max(0, best[1] - len(item.text) - item.k) : best[1]][::-1])
                out.append((item.key, best[0], best[1] - back[1], best[1]))
        return out


_SEARCHERS: dict[str, Searcher] = {}


def _hits(text: Column, items: list[tuple[str, str]], errors: float, session) -> Column:
    shared, name = session.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(MATCH)
    def of(texts: pd.Series) -> pd.Series:
        if name not in _SEARCHERS:
            _SEARCHERS.clear()  # of an earlier pass in this worker
            _SEARCHERS[name] = Searcher(shared.value, errors)
        search = _SEARCHERS[name].search
        return pd.Series([[dict(zip(("item", "distance", "start", "end"), h, strict=True)) for h in search(t)] for t in texts])

    return of(text)


def passes(benchmark: DataFrame, item: str, text: str, most: int = PASS_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The items, normalised, in lists of at most about ``most`` characters.

    Lists are made by a hash of the item's text, and fetched one by one, so
    neither the driver nor a broadcast holds more than one list whatever the
    benchmark's size.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("x")).distinct()
    chars = rows.agg(F.sum(F.length("x"))).first()[0] or 0
    count = max(1, -(-chars * 5 // (most * 4)) if chars > most else 1)
    for n in range(count):
        part = rows.where(F.pmod(F.xxhash64("x", "i"), F.lit(count)) == n).collect()
        yield sorted((r["i"] or "", normalised(r["x"])) for r in part)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row per document row and test item found in it: ``key``, ``item`` (as text), ``distance``, ``start``, ``end``.

    A match is any stretch of the whole normalised document within
    ``errors`` x length edits of the normalised item; the nearest is reported,
    with its place in normalised characters.  NULL and empty documents match
    nothing; NULL and blank items are never found.  Repeated rows are reported
    each; repeated items once.  Documents are not shuffled; one pass is made
    per list of test items.  Other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    for items in passes(benchmark, item, item_text):
        found = docs.select(F.col(key).alias("k"), F.explode(_hits(F.col(text), items, errors, spark)).alias("h"))
        rows = found.select(F.col("k").alias(key), "h.item", "h.distance", "h.start", "h.end")
        out = rows if out is None else out.unionAll(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` in which no test item is found; their columns stay as they are."""
    for items in passes(benchmark, item, item_text):
        docs = docs.where(F.size(_hits(F.col(text), items, errors, docs.sparkSession)) == 0)
    return docs
