"""The words of many texts at once: places and hashes as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Characters of the texts that are taken together.
TAKEN = 200_000
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
#: Beyond the last white space, U+3000, no code point is looked up.
LAST = 0x3001
SPACE = np.array([chr(c).isspace() for c in range(LAST + 1)])
CODE = np.random.default_rng(41).integers(0, 1 << 64, size=1 << 16, dtype=np.uint64)

_held = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ODD and of its inverse."""
    if len(_held[0]) < n:
        for i, base in enumerate((ODD, INVERSE)):
            x = np.full(max(n, 2 * TAKEN), base, dtype=np.uint64)
            x[0] = 1
            _held[i] = np.multiply.accumulate(x)
    return _held[0][:n], _held[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


def sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which ``stretch`` takes the hash of any stretch."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(len(hashes))[1], out=out[1:])
    return out


def stretch(run: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hashes of the stretches [a, b); they depend on what is in them alone."""
    return _mixed((run[b] - run[a]) * _powers(len(run))[0][a])


def grams(run: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` in a row, from their running sums."""
    n = len(run) - width
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    return _mixed((run[width:] - run[:-width]) * _powers(n)[0])


class Words(NamedTuple):
    """Words of texts joined by line ends, lower-cased for the hash alone: of each text, its first character and first word
    (and where they would go on); of each word, hash, first character and the one after the last."""

    codes: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _codes(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(codes) + 2, dtype=bool)
    gap[1:-1] = SPACE[codes if codes.dtype == np.uint8 else np.minimum(codes, LAST)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def words(texts: list[str]) -> Words:
    """The words of ``texts``, as ``str.lower`` and ``str.split`` make them."""
    joined = "\n".join(texts)
    codes = _codes(joined)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begin[1:])
    start, end = _bounds(codes)
    low = joined.lower()
    lowered = codes if low == joined else _codes(low)
    # A letter may become two; no word appears or goes by that.
    a, b = (start, end) if len(low) == len(joined) else _bounds(lowered)
    if lowered.dtype == np.uint8:
        letters = CODE[lowered]
    else:
        letters = CODE[lowered & 0xFFFF]
        far = np.flatnonzero(lowered > 0xFFFF)
        letters[far] += CODE[lowered[far] >> 16] * np.uint64(ODD)
    return Words(codes, begin, np.searchsorted(start, begin), stretch(sums(letters), a, b), start, end)


def taken(batches: Iterator[pa.RecordBatch], text: int, chars: int = TAKEN) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of column ``text``, and these texts."""
    for batch in batches:
        held: list[str] = []
        at = size = 0
        for x in batch.column(text):
            held.append(x.as_py() or "")
            size += len(held[-1])
            if size >= chars:
                yield batch.slice(at, len(held)), held
                at, held, size = at + len(held), [], 0
        if held:
            yield batch.slice(at, len(held)), held


def least(x: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest of every ``span`` values in a row."""
    n = len(x) - span + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    at, low, wide = np.arange(len(x)), x, 1
    while wide < span:
        step = min(wide, span - wide)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        wide += step
    return at


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (lengths[0] of them), then those of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
