"""BPE encoding and decoding with a minimal acyclic transducer for frequent words."""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import discard, written
from crosstide.llm.words import ranges, taken

#: Words of the lexicon at most, and the longest word (bytes) it takes.
LEXICON_WORDS, LEXICON_BYTES = 200_000, 48
#: Characters encoded at a time, and words a task remembers between chunks.
CHUNK_CHARS, REMEMBERED = 1_000_000, 400_000
#: Distinct words a counting task holds before it passes them on.
COUNTED = 400_000
#: The split pattern whose words ``Merges.tokens`` finds by arrays, and the classes of its characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER, SPACE, LETTER, DIGIT, SPECIAL = range(5)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return [chr(moved.get(b, b)) for b in range(256)]


def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), OTHER, dtype=np.uint8)
    for kind, members in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for run in regex.finditer(members, every):
            out[run.start() : run.end()] = kind
    return out


def _shortened(codes: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """Sets the starts of 's, 't, 're, 've, 'm, 'll, 'd, and of what follows them: an apostrophe that begins a word takes these letters."""
    at = np.flatnonzero((codes == ord("'")) & start & (kind == OTHER))
    at = at[kind[at + 1] == LETTER]
    a, b = codes[at + 1], codes[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = np.zeros(len(at), dtype=bool)
    for x, y in ("re", "ve", "ll"):
        two |= (a == ord(x)) & (b == ord(y))
    start[at[one | two] + 1] = False
    after = np.concatenate([at[one] + 2, at[two] + 3])
    start[after] |= kind[after] == LETTER


class Merges:
    """A word-end BPE vocabulary: words to ids by merging, ids to text.

    Reads the ``tokenizers`` file format (NFC, lower case, a split pattern,
    byte letters, a suffix on each word's last symbol).
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in (vocab | self.special).items()}
        self.pieces = [names.get(i, "") for i in range(max(names) + 1)]
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.classes = _classes() if self.pattern.pattern == SPLIT else None
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str | None) -> list[str]:
        """A text's words in order; a special token's string stays one word, in its own case."""
        out = []
        for i, part in enumerate(self._parts(text or "")):
            out += [part] if i % 2 else self.pattern.findall(self._normal(part))
        return out

    def _parts(self, text: str) -> list[str]:
        """Plain text and special tokens in turn."""
        return self.apart.split(text) if self.apart and any(s in text for s in self.special) else [text]

    def _normal(self, text: str) -> str:
        # Lower case goes letter by letter: a sigma's form does not depend on its place.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def tokens(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The ``words`` of all texts as one array, and where each text's begin in it (and the last's end)."""
        if self.classes is None:
            found = [self.words(x) for x in texts]
            return pa.array([w for one in found for w in one], pa.string()), np.cumsum([0, *map(len, found)])
        parts, begin, marks, at = [], [], [], 0
        for text in texts:
            begin.append(at)
            for i, part in enumerate(self._parts(text)):
                if i % 2:
                    marks.append(slice(at, at + len(part)))
                else:
                    part = self._normal(part)
                parts.append(part)
                at += len(part) + 1
        parts.append("")
        joined = "\n".join(parts)  # a line end after each part keeps its words from the next one's
        data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        codes = data if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[codes]
        for mark in marks:
            kind[mark] = SPECIAL
        keep = kind != SPACE
        start = keep.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        _shortened(codes, kind, start)
        cuts = np.searchsorted(np.flatnonzero(start), [*begin, at])
        if codes is data:
            first, kept = np.flatnonzero(start[keep]), data[keep]
        else:
            width = (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF) + np.uint8(1)
            kept, width = data[np.repeat(keep, width)], width[keep]
            first = (np.cumsum(width, dtype=np.int64) - width)[start[keep]]
        ends = np.append(first, len(kept)).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(kept)), cuts

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word: the adjacent pair of lowest rank, leftmost first, until none is left."""
        if word in self.special:
            return (self.special[word],)
        data = word.encode("utf-8", "surrogatepass")
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        if len(ids) > 40:
            return self._merge_long(ids)
        get = self.rank.get
        ranks = [get(p, 1 << 30) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [self.merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), 1 << 30)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), 1 << 30)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap, so one very long word stays quick."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.rank.get((ids[i], ids[j])) != low:
                continue
            ids[i], ids[j] = self.merged[low], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := self.rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return tuple(x for x in ids if x >= 0)

    def decode(self, ids) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))


@dataclass
class Lexicon:
    """A memory-mapped minimal acyclic transducer from words (bytes) to token ids.

    States with the same continuations are one state.  Each arc carries the
    number of accepted words before it, so a path's sum is the word's rank,
    which points into the table of ids.
    """

    key: np.ndarray  # state * 256 + byte, ascending
    target: np.ndarray
    skip: np.ndarray
    final: np.ndarray
    start: np.ndarray  # of each word's ids
    ids: np.ndarray

    FIELDS = {"key": np.int64, "target": np.int32, "skip": np.int32, "final": np.uint8, "start": np.int64, "ids": np.int32}

    @staticmethod
    def build(words: dict[bytes, tuple[int, ...]]) -> Lexicon:
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        counts: list[int] = []
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        last = b""

        def settle(state: tuple[bool, list[tuple[int, int]]]) -> int:
            frozen = (state[0], tuple(state[1]))
            if (at := register.setdefault(frozen, len(states))) == len(states):
                states.append(frozen)
                counts.append(frozen[0] + sum(counts[to] for _, to in frozen[1]))
            return at

        ordered = sorted(words)
        for word in ordered:
            same = len(os.path.commonprefix([last, word]))
            while len(path) - 1 > same:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path += [(i == len(word) - 1, []) for i in range(same, len(word))]
            if same == len(word):
                path[-1] = (True, path[-1][1])
            last = word
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = settle(path[0])
        key, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            before = int(final)
            for byte, to in arcs:
                key.append(s * 256 + byte)
                target.append(to)
                skip.append(before)
                before += counts[to]
        out = [words[w] for w in ordered]
        start = np.concatenate([[root], np.cumsum([0, *map(len, out)])])  # the root state goes first
        flat = [i for w in out for i in w]
        raw = {"key": key, "target": target, "skip": skip, "final": [f for f, _ in states], "start": start, "ids": flat}
        return Lexicon(**{k: np.asarray(raw[k], dtype=t) for k, t in Lexicon.FIELDS.items()})

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            np.array([len(getattr(self, k)) for k in self.FIELDS], dtype=np.int64).tofile(f)
            for k in sorted(self.FIELDS, key=lambda k: -np.dtype(self.FIELDS[k]).itemsize):
                getattr(self, k).tofile(f)

    @staticmethod
    def open(path: str) -> Lexicon:
        whole = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
        sizes = dict(zip(Lexicon.FIELDS, whole[: 8 * len(Lexicon.FIELDS)].view(np.int64).tolist(), strict=True))
        at, parts = 8 * len(Lexicon.FIELDS), {}
        for k in sorted(Lexicon.FIELDS, key=lambda k: -np.dtype(Lexicon.FIELDS[k]).itemsize):
            size = sizes[k] * np.dtype(Lexicon.FIELDS[k]).itemsize
            parts[k] = whole[at : at + size].view(Lexicon.FIELDS[k])
            at += size
        return Lexicon(**parts)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, or -1: all words walk the automaton together, byte by byte."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        state = np.full(n, self.start[0], dtype=np.int64)
        rank = np.zeros(n, dtype=np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES)) if len(self.key) else np.zeros(0, dtype=np.int64)
        found = np.full(n, -1, dtype=np.int64)
        step = 0
        while len(live):
            want = state[live] * 256 + data[first[live] + step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[arc] == want
            live, arc = live[hit], arc[hit]
            rank[live] += self.skip[arc]
            state[live] = self.target[arc]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = rank[done]
            live = live[~ended]
        return found

    def ids_of(self, rank: int) -> tuple[int, ...]:
        return tuple(self.ids[self.start[rank + 1] : self.start[rank + 2]].tolist())


class Encoder:
    """Merges, a lexicon in front of them, and the words met lately with their ids in one flat array."""

    def __init__(self, merges: Merges, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.pieces = pa.array(merges.pieces, pa.string())
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        ranks = self.lexicon.ranks([w.encode("utf-8", "surrogatepass") for w in new])
        hit, miss = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        merged = [self.merges.merge(new[i]) for i in miss.tolist()]
        n, known = len(new), len(self.number)
        source = self.lexicon.start[ranks[hit] + 1]
        lengths = np.zeros(n, dtype=np.int64)
        lengths[hit] = self.lexicon.start[ranks[hit] + 2] - source
        lengths[miss] = list(map(len, merged))
        at = int(self.start[known])
        ends = at + np.cumsum(lengths)
        while len(self.start) <= known + n:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        first = ends - lengths
        self.ids[ranges(first[hit], lengths[hit])] = self.lexicon.ids[ranges(source, lengths[hit])]
        self.ids[ranges(first[miss], lengths[miss])] = [i for one in merged for i in one]
        self.start[known + 1 : known + n + 1] = ends
        self.number.update(zip(new, range(known, known + n), strict=True))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts; each different word is looked up once."""
        if len(self.number) > REMEMBERED:
            self.forget()
        tokens, cuts = self.merges.tokens(texts)
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn([w for w in words if w not in self.number])
        number = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        first, lengths = self.start[number], self.start[number + 1] - self.start[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends[cuts].astype(np.int32)), pa.array(self.ids[ranges(first, lengths)]))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of id lists, whatever made them."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.pieces.take(ids.values)), " ")


_OPEN: dict[str, Merges | Encoder] = {}


def _merges(tokenizer: str) -> Merges:
    if tokenizer not in _OPEN:
        _OPEN[tokenizer] = Merges(SparkFiles.get(tokenizer))
    return _OPEN[tokenizer]


def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    if lexicon not in _OPEN:
        for old in [k for k, v in _OPEN.items() if isinstance(v, Encoder)]:
            del _OPEN[old]  # of an earlier job in this worker
        _OPEN[lexicon] = Encoder(_merges(tokenizer), Lexicon.open(SparkFiles.get(lexicon)))
    return _OPEN[lexicon]


def _shipped(spark: SparkSession, path: str) -> str:
    """The file's name on every executor, lost and new ones included."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def sampled(docs: DataFrame, rows: int = 20_000) -> DataFrame:
    """About ``rows`` rows of ``docs`` drawn at random, all of them if there are no more; for a quick look at ``word_counts``."""
    total = docs.count()
    return docs if total <= rows else docs.sample(rows / total, seed=8)


def _added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One row per word from batches of (word, n)."""
    if not held:
        return []
    table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches(max_chunksize=50_000)


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word, n) over the texts of ``docs``; summed in each task before the shuffle, in bounded memory."""
    name = _shipped(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held, rows = _merges(name), [], 0
        for _, texts in taken(batches, 0, CHUNK_CHARS):
            held.append(pa.RecordBatch.from_arrays(merges.tokens(texts)[0].value_counts().flatten(), ["word", "n"]))
            rows += held[-1].num_rows
            if rows > 2 * COUNTED:
                held = _added(held)
                rows = sum(x.num_rows for x in held)
                if rows > COUNTED:
                    yield from held
                    held, rows = [], 0
        yield from _added(held)

    partial = docs.select(F.col(text).cast("string").alias("x")).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The words above the lowest count that keeps the list within ``most``.

    The cut comes from a histogram of counts (eighths of an octave), so no
    sort of all words is needed, and words of one count are taken or left
    together.
    """
    octave = F.floor(F.log2("n") * 8).cast("int").alias("octave")
    bars = counts.groupBy(octave).agg(F.count(F.lit(1)).alias("words")).collect()  # a few hundred rows at most
    cut, total = None, 0
    for bar in sorted(bars, key=lambda r: -r["octave"]):
        total += bar["words"]
        if total > most:
            break
        cut = bar["octave"]
    if cut is None:
        return []
    picked = counts.where((F.floor(F.log2("n") * 8) >= cut) & (F.octet_length("word") <= LEXICON_BYTES))
    return [r["word"] for r in picked.select("word").collect()]


def ship_lexicon(spark: SparkSession, tokenizer: str, words: list[str]) -> str:
    """Compiles ``words`` and sends the file to all executors; returns its name there."""
    merges = Merges(tokenizer)
    built = Lexicon.build({w.encode("utf-8"): merges.merge(w) for w in words})
    handle, path = tempfile.mkstemp(prefix="lexicon-", suffix=".bin")  # the driver serves it from here
    os.close(handle)
    built.save(path)
    return _shipped(spark, path)


def encoded(docs: DataFrame, key: str, tokenizer: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` for every row of ``docs``.

    ``ids`` are those of the tokenizer file for the whole text, special tokens
    recognised but not added; ``decoded`` is read back from the ids (pieces
    joined by a space, as a tokenizer without a decoder does).  NULL, empty
    and blank texts give no ids and an empty decoded text.  Rows stay rows:
    repeated ones give equal results, an empty table an empty one.  Other
    columns are ignored.

    The words of all texts are counted; the frequent ones, at most
    ``lexicon_words``, are compiled on the driver and mapped into each
    executor's memory.  Then all texts are encoded without a shuffle.  The
    lexicon only saves merging: any choice of words gives the same ids.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs, tokenizer, text), "words")
    lexicon, name = ship_lexicon(spark, tokenizer, frequent_words(counts, lexicon_words)), os.path.basename(tokenizer)
    discard(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, lexicon)
        try:
            for batch, texts in taken(batches, 1, CHUNK_CHARS):
                ids = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, encoder.decode(ids)], ["key", "ids", "decoded"])
        finally:  # idle workers outlive the stage, and all of an executor's share its memory
            encoder.forget()
            pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("x"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").select(F.col("key").alias(key), "ids", "decoded")
