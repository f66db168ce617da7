"""Document quality from preference pairs (Bradley-Terry), cut at a score quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import matched, written
from crosstide.operators.ranking import numbered

#: Score at which a document is accepted.
ACCEPT = 0.7
#: Preference pairs that a fit forms at least, if the labels give so many.
PAIRS = 40_000

#: Character classes whose shares are features; fixed values.
CLASSES = {
    "space": " ",
    "line_feed": "\n",
    "stop": ".",
    "comma": ",;:",
    "exclaim": "!?",
    "symbol": "#$%&*@^~+=<>\\/_",
    "bar": "|",
    "bracket": "()[]{}\"'`-",
    "digit": "0123456789",
}
NAMES = [*CLASSES, "upper", "letter", "other", "word_length", "words", "distinct", "repeat", "most_common", "symbol_end", "line_repeat", "empty"]
_MEMBERS = np.zeros((128, len(CLASSES)))
for _i, _chars in enumerate(CLASSES.values()):
    _MEMBERS[[ord(c) for c in _chars], _i] = 1.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def features(text: str | None) -> np.ndarray:
    """One vector per whole text, from the text alone; NULL is the empty text."""
    text = text or ""
    out = np.zeros(len(NAMES))
    words = text.split()
    if not words:
        out[-1] = 1.0
        return out
    codes, low, up = _codes(text), _codes(text.lower()), _codes(text.upper())
    n = len(codes)
    plain = np.bincount(codes[codes < 128], minlength=128)
    k = len(CLASSES)
    out[:k] = plain @ _MEMBERS / n
    if len(low) == n == len(up):
        letters = max(1, int((low != up).sum()))
        out[k] = int((codes != low).sum()) / letters
    else:  # a few letters change length with their case
        letters = max(1, sum(c.lower() != c.upper() for c in text))
        out[k] = sum(c != c.lower() for c in text) / letters
    out[k + 1] = letters / n
    out[k + 2] = 1.0 - out[:k].sum() - out[k + 1]
    w = len(words)
    counts = Counter(words)
    out[k + 3] = sum(map(len, words)) / w / 10.0
    out[k + 4] = math.log1p(w) / 10.0
    out[k + 5] = len(counts) / w
    out[k + 6] = sum(map(eq, words, words[1:])) / w
    out[k + 7] = max(counts.values()) / w
    out[k + 8] = sum(not x[-1].isalnum() and x[-1] not in ".,;:" for x in words) / w
    lines = text.split("\n")
    out[k + 9] = 1.0 - len(set(lines)) / len(lines)
    return out


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features; ``cut`` is the raw score that becomes ``ACCEPT``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + math.log(ACCEPT / (1 - ACCEPT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


Sums = tuple[float, np.ndarray, np.ndarray]


def pair_sums(d: np.ndarray, w: np.ndarray) -> Sums:
    """Loss, slope and curve of the weights, summed over feature differences (preferred minus other row)."""
    z = d @ w
    p = 1.0 / (1.0 + np.exp(np.clip(z, -700, 700)))
    return float(np.logaddexp(0, -z).sum()), -(d.T @ p), (d * (p * (1 - p))[:, None]).T @ d


def _minimised(sums: Callable[[np.ndarray], Sums], n: int, k: int, ridge: float, steps: int) -> np.ndarray:
    """The weights of least mean loss plus ridge, by Newton steps; ``sums`` is asked once a step if none has to be shortened."""

    def at(w: np.ndarray) -> Sums:
        loss, slope, curve = sums(w)
        return loss / n + ridge * w @ w / 2, slope / n + ridge * w, curve / n + ridge * np.eye(k)

    w = np.zeros(k)
    loss, slope, curve = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(curve, slope), 1.0
        new = at(w - step)
        while new[0] > loss and size > 1e-4:
            size /= 2
            new = at(w - size * step)
        w = w - size * step
        loss, slope, curve = new
        if float(np.abs(size * step).max()) < 1e-6:
            break
    return w


def pair_count(good: int, bad: int, pairs: int = PAIRS) -> int:
    """How many pairs a fit forms: two for each row, ``pairs`` at least, but no pair twice."""
    return min(max(pairs, 2 * (good + bad)), good * bad)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 50) -> Ranker:
    """Bradley-Terry scores from feature rows ``x`` and labels ``y`` (1 preferred to 0).

    Pairs of a preferred and another row are dealt evenly over both sides, every
    row in one at least; the logistic loss on their feature differences is
    minimised by Newton steps.  The cut is the score quantile at the share of
    the other rows.  Without both labels there is no pair: every text then
    scores exactly ``ACCEPT``.  ``fit`` does the same over a table.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return _nothing_learnt()
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - mean) / scale
    draw = np.random.default_rng(7)
    good, bad = draw.permutation(good), draw.permutation(bad)
    t = np.arange(pair_count(len(good), len(bad), pairs))
    d = z[good[t % len(good)]] - z[bad[(t + t // math.lcm(len(good), len(bad))) % len(bad)]]
    w = _minimised(lambda w: pair_sums(d, w), len(d), len(NAMES), ridge, steps)
    raw = np.sort(z @ w)
    at = len(bad)  # as many rows fall below the cut as are labelled 0
    return Ranker(mean, scale, w, float((raw[at - 1] + raw[at]) / 2))


def _nothing_learnt() -> Ranker:
    k = len(NAMES)
    return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)


def held_out(key: Column) -> Column:
    """The rows no fit may see: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int | None = None) -> Ranker:
    """A ranker from all labelled documents that are not held out; with ``sample`` from so many of them.

    Several labels of one document count by their mean; NULL keys and labels
    are left out.  Each labelled text becomes a short vector, numbered by label
    and hash.  The pairs of ``fit_pairs`` follow from the numbers, meet by two
    joins and are stored; a Newton step is a pass in which each task adds up
    its pairs, and the cut is searched in passes that count.  The driver holds
    no row, only sums of a task and bars of a histogram.
    """
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    votes = votes.groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("vote"))
    if sample is not None:
        votes = votes.orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = matched(docs.select(F.col(key).alias("k"), F.col(text).alias("x")), written(votes, "votes"), "k")
    found = texts.select((F.col("vote") >= 0.5).cast("int").alias("y"), F.xxhash64("k", "x").alias("h"), _feature_column(F.col("x")).alias("f"))
    rows = written(numbered(written(found, "features"), "place", F.col("y"), F.col("h"), F.col("f")).select("y", "place", "f"), "labelled")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    bad = n - good
    if not good or not bad:
        return _nothing_learnt()
    facts = rows.select(Summarizer.metrics("mean", "std").summary(array_to_vector("f")).alias("s")).first()
    # Sums of tasks differ in their last digits with the order they come in; rounded, a layout no longer shows.
    mean, scale = np.round(facts["s"]["mean"].toArray(), 12), np.round(facts["s"]["std"].toArray() * math.sqrt((n - 1) / n), 12)
    scale = np.where(scale < 1e-9, 1.0, scale)
    weights = np.round(_minimised(_task_sums(_dealt(rows, good, bad), scale), pair_count(good, bad), len(NAMES), 1e-3, 50), 9)
    rank = Ranker(mean, scale, weights, 0.0)
    raw = written(rows.select(_raw_column(rank)(F.col("f")).alias("raw")), "raw")
    low, high = (value_at(raw, "raw", at) for at in (bad - 1, bad))
    return Ranker(mean, scale, weights, (low + high) / 2)


def _dealt(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """The stored feature differences ``d`` of all pairs; the numbers of the rows labelled 0 go before."""
    t, turn = F.col("id"), math.lcm(good, bad)
    pairs = rows.sparkSession.range(pair_count(good, bad)).select(
        (bad + 1 + t % good).alias("i"), (1 + (t + F.floor(t / turn)) % bad).alias("j")
    )
    one = rows.where("y = 1").select(F.col("place").alias("i"), F.col("f").alias("a"))
    other = rows.where("y = 0").select(F.col("place").alias("j"), F.col("f").alias("b"))
    return written(pairs.join(one, "i").join(other, "j").select(F.zip_with("a", "b", lambda x, y: x - y).alias("d")), "pairs")


def _task_sums(pairs: DataFrame, scale: np.ndarray) -> Callable[[np.ndarray], Sums]:
    """``pair_sums`` over a table of differences: a row of sums from each task."""
    k = len(NAMES)

    def sums(w: np.ndarray) -> Sums:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, curve = 0.0, np.zeros(k), np.zeros((k, k))
            for batch in batches:
                one = pair_sums(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) / scale, w)
                loss, slope, curve = loss + one[0], slope + one[1], curve + one[2]
            yield pa.RecordBatch.from_arrays([pa.array([[loss, *slope, *curve.ravel()]])], ["sums"])

        whole = np.sum([r["sums"] for r in pairs.mapInArrow(add, "sums array<double>").toLocalIterator()], axis=0)
        return float(whole[0]), whole[1 : k + 1], whole[k + 1 :].reshape(k, k)

    return sums


def _raw_column(ranker: Ranker) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([float(ranker.raw(f)) for f in rows])

    return of


def value_at(df: DataFrame, value: str, place: int, bars: int = 1024) -> float:
    """The value at ``place`` (from 0) of the ascending order, exactly.

    A pass counts the values of the range left in equal bars and goes on with
    the one that holds the place, until its least and greatest value are one.
    """
    x = F.col(value)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while low < high:
        bar = F.least(F.floor((x - low) / (high - low) * bars), F.lit(bars - 1)).alias("bar")
        inside = df.where(x.between(low, high))
        for r in inside.groupBy(bar).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("bar").collect():
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return float(low)


def scored(docs: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in 0 to 1 for every whole text, NULL and empty ones too; no shuffle.

    A column named ``out`` is replaced.  Equal texts score alike.
    """

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return pd.Series(ranker.score(x))

    return docs.withColumn(out, of(F.col(text)))


def predicted(score: Column) -> Column:
    return F.when(score >= ACCEPT, 1).otherwise(0)
