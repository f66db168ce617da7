"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters encoded at a time.
CHUNK_CHARS = 2_000_000
#: Rounds after which what is left (long stretches that merge one pair at a time) goes through a queue.
ROUNDS = 256
NORMAL, BYTE = 1, 6
_NONE = np.int64(1 << 62)
_CODES = 0x110000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + size]
            i += size


class Pieces:
    """A SentencePiece BPE model file with byte fallback, identity normalisation and a dummy prefix.

    Symbols are piece ids; a character that is no piece has the number of
    pieces plus its code point, and comes out as the ids of its bytes.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        rows = [dict(_fields(v)) for k, v in top if k == 1]
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        rules = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("the model must be BPE with byte fallback, without normalisation, with a dummy prefix and all spaces kept")
        self.texts = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if not set(kinds) <= {NORMAL, BYTE, 2, 3}:
            raise ValueError("user-defined and unused pieces are not supported")
        n = self.size = len(rows)
        known = {t: i for i, (t, kind) in enumerate(zip(self.texts, kinds, strict=True)) if kind == NORMAL}
        self.byte_ids = np.array([self.texts.index(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.symbol = np.arange(n, n + _CODES, dtype=np.int64)
        for text, i in known.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        score = [float(np.frombuffer(r.get(2, b"\0\0\0\0"), dtype="<f4")[0]) for r in rows]
        order = {s: at for at, s in enumerate(sorted({-score[i] for i in known.values()}))}
        self.span = n + _CODES
        pairs: dict[int, tuple[int, int]] = {}
        for text, i in known.items():
            for cut in range(1, len(text)):
                a, b = (known.get(x, n + ord(x) if len(x) == 1 else -1) for x in (text[:cut], text[cut:]))
                if a >= 0 and b >= 0:
                    pairs[a * self.span + b] = (order[-score[i]], i)
        self.keys = np.array([*sorted(pairs), _NONE], dtype=np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in sorted(pairs)), _NONE], dtype=np.int64)
        self.made = np.array([*(pairs[k][1] for k in sorted(pairs)), 0], dtype=np.int64)
        self.block = 2 * max(map(len, known))
        # A space never follows another character inside a piece, so texts fall into words there; and a
        # character that no longer piece holds is a word by itself.
        longer = [t for t in known if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in longer):
            raise ValueError("a piece crosses a space")
        joined = "".join(map(re.escape, sorted({c for t in longer for c in t} - {SPACE})))
        self.word = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{SPACE}{joined}]" if joined else f"{SPACE}+|[^{SPACE}]", re.DOTALL)
        values = [(t.replace(SPACE, " ") if kind in (NORMAL, 2) else "").encode() for t, kind in zip(self.texts, kinds, strict=True)]
        for b, i in enumerate(self.byte_ids.tolist()):
            values[i] = bytes([b])
        # the second half: the pieces as they stand at the beginning of a text
        self.bytes_of = pa.array([*values, *(v[t.startswith(SPACE) :] for v, t in zip(values, self.texts, strict=True))], pa.binary())

    def words(self, text: str | None) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of symbol pairs; rank ``_NONE`` where they do not merge."""
        want = a * self.span + b
        at = np.searchsorted(self.keys, want)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has.

        The symbols of all words lie in flat arrays.  A round finds the pair of
        lowest rank, the leftmost of equal ones, in every word, merges all of
        these at once, drops the absorbed symbols and the words that are done,
        and ranks the pairs beside the merged ones anew.  Words longer than a
        block fall into blocks of twice the longest piece; a block's pair
        merges if it comes before those of both blocks beside it: a symbol
        grown elsewhere is too short to reach it first, so the order of merges
        of a single queue over the word gives the same symbols.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes))
        within = place - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block = np.cumsum(within % self.block == 0)
        symbol = self.symbol[codes]
        final = np.full(len(codes), -1, dtype=np.int64)
        rank, made = np.full(len(codes), _NONE), np.zeros(len(codes), dtype=np.int64)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at], made[at] = self._pairs(symbol[at], symbol[at + 1])
        for turn in range(ROUNDS + 1):
            # Words without a pair left are done.
            some = np.zeros(len(words), dtype=bool)
            some[word[rank < _NONE]] = True
            stay = some[word]
            final[place[~stay]] = symbol[~stay]
            symbol, word, place, block, rank, made = (x[stay] for x in (symbol, word, place, block, rank, made))
            if not len(symbol):
                break
            if turn == ROUNDS:
                self._finish(symbol, word, place, final)
                break
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            index = np.arange(len(symbol))
            best = np.minimum.reduceat(np.where(rank < _NONE, (rank << 40) | index, _NONE), first)
            beside = word[first[1:]] == word[first[:-1]]
            ready = best < _NONE
            ready[1:] &= ~beside | (best[1:] < best[:-1])
            ready[:-1] &= ~beside | (best[:-1] < best[1:])
            at = best[ready] & ((1 << 40) - 1)
            symbol[at] = made[at]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            symbol, word, place, block, rank, made = (x[stay] for x in (symbol, word, place, block, rank, made))
            at -= np.arange(len(at))  # one symbol went before each later one
            rank[at] = _NONE
            last = len(symbol) - 1
            for left in (at[at < last], at[at > 0] - 1):
                left = left[word[left] == word[left + 1]]
                rank[left], made[left] = self._pairs(symbol[left], symbol[left + 1])
        starts = np.flatnonzero(final >= 0)
        symbol, word = final[starts], np.repeat(np.arange(len(words)), lengths)[starts]
        strange = symbol >= self.size
        sizes = np.ones(len(symbol), dtype=np.int64)
        code = symbol[strange] - self.size
        sizes[strange] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        ids = np.repeat(np.where(strange, -1, symbol), sizes)
        spelled = code.astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[ids < 0] = self.byte_ids[np.frombuffer(spelled, dtype=np.uint8)]
        return ids, np.bincount(word, weights=sizes, minlength=len(words)).astype(np.int64)

    def _finish(self, symbol: np.ndarray, word: np.ndarray, place: np.ndarray, final: np.ndarray) -> None:
        """The same merges by a queue, for the words that ``ROUNDS`` rounds left over."""
        table = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=True)}
        ids, of, n = symbol.tolist(), word.tolist(), len(symbol)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def pair(i: int) -> tuple[int, int] | None:
            j = after[i]
            return table.get(ids[i] * self.span + ids[j]) if j >= 0 and of[i] == of[j] else None

        queue = [(p[0], i, p[1]) for i in range(n) if (p := pair(i))]
        heapq.heapify(queue)
        while queue:
            rank, i, product = heapq.heappop(queue)
            if ids[i] < 0 or pair(i) != (rank, product):
                continue
            j = after[i]
            ids[i], ids[j], after[i] = product, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (p := pair(a)):
                    heapq.heappush(queue, (p[0], a, p[1]))
        final[place] = ids

    def encode_texts(self, texts: list[list[str]]) -> pa.ListArray:
        """Ids of texts given as word lists; a word that occurs often is merged once."""
        words = pa.array([w for one in texts for w in one], pa.string()).dictionary_encode()
        ids, counts = self.encode(words.dictionary.to_pylist())
        number = words.indices.to_numpy(zero_copy_only=False)
        first, lengths = (np.cumsum(counts) - counts)[number], counts[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        taken = np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])
        cuts = np.cumsum([0, *map(len, texts)])
        return pa.ListArray.from_arrays(pa.array(ends[cuts].astype(np.int32)), pa.array(ids[taken].astype(np.int32)))

    def decode_texts(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists: pieces joined, bytes put together, the prefix's space taken off."""
        offsets, pieces = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int64)
        pieces[offsets[:-1][offsets[1:] > offsets[:-1]]] += self.size
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes_of.take(pa.array(pieces))), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # ids that are not those of any text
            return pa.array([_readable(b) for b in joined.to_pylist()], pa.string())


def _readable(data: bytes) -> str:
    """``data`` as text, each byte outside a character as U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_OPEN: dict[str, Pieces] = {}


def _pieces(name: str) -> Pieces:
    if name not in _OPEN:
        _OPEN[name] = Pieces(SparkFiles.get(name))
    return _OPEN[name]


def encoded(docs: DataFrame, key: str, model: str, text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` for every row of ``docs``.

    ``ids`` are those of the model file for the whole text, without begin and
    end ids; ``decoded`` is read back from the ids.  NULL and empty texts give
    no ids and an empty decoded text; blank ones give the ids of their spaces.
    Rows stay rows: repeated ones give equal results, an empty table an empty
    one.  Other columns are ignored, whatever their names.

    A map over rows without a shuffle; the model file travels with the job.
    """
    docs.sparkSession.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(name)
        for batch in batches:
            start = chars = 0
            texts: list[list[str]] = []
            for i, one in enumerate(batch.column(1)):
                text = one.as_py() or ""
                texts.append(pieces.words(text))
                chars += len(text)
                if chars >= CHUNK_CHARS or i == batch.num_rows - 1:
                    ids = pieces.encode_texts(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), ids, pieces.decode_texts(ids)], ["key", "ids", "decoded"])
                    start, chars, texts = i + 1, 0, []

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("x"))
    out = rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, ids array<int>, decoded string")
    return out.select(F.col("key").alias(key), "ids", "decoded")
