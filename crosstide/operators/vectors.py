"""Vector search, text chunks, clusters.

Vector tables are (id, embedding); similarities are cosines.  Products run as
matrix blocks in Arrow batches.  Each task keeps only its best k per query, so
the shuffle that merges them moves k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import let
from crosstide.session import cut_lineage

MAX_QUERIES = 4096
BLOCK_ROWS = 50_000
OUT = "query_id {q}, id {v}, similarity double"
CENTRES = "cluster int, centre array<double>"
#: Vectors in one matrix product against the centres, moves of the centres between two splits, and in all.
NEAREST_ROWS, MOVES, MOST_MOVES = 2_000, 3, 100
#: Cells of such a product, centres whose sums are added up together, tasks of a pass per core.
PRODUCT_CELLS, PIECE, TASKS_PER_CORE = 8_000_000, 64, 2


def _unit(rows) -> np.ndarray:
    matrix = np.vstack([np.asarray(r, dtype="float64") for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _pairs(q_ids, q_unit, v_ids, v_unit, k: int | None, threshold: float | None) -> pd.DataFrame:
    """Query and vector ids with their cosine; the best k per query if asked."""
    # last bits of a matrix product depend on the block's shape; equal vectors
    # must rank as equal
    scores = np.round(q_unit @ v_unit.T, 12)
    q_ids, v_ids = np.asarray(q_ids), np.asarray(v_ids)
    keep = np.ones(scores.shape, dtype=bool) if k is None and threshold is None else ~np.isnan(scores)
    if threshold is not None:
        keep &= scores > threshold
    if k is not None and k < scores.shape[1]:
        shown = np.where(keep, scores, -np.inf)
        cut = np.partition(shown, -k, axis=1)[:, -k][:, None]
        keep &= shown >= cut
        for row in np.nonzero(keep.sum(axis=1) > k)[0]:  # many copies tie at the cut
            tied = np.nonzero(keep[row])[0]
            order = np.lexsort((v_ids[tied], -scores[row, tied]))
            keep[row, tied[order[k:]]] = False
    at_q, at_v = np.nonzero(keep)
    return pd.DataFrame(
        {"query_id": q_ids[at_q], "id": v_ids[at_v], "similarity": pd.Series(scores[at_q, at_v]).astype(object).where(lambda x: x.notna(), None)}
    )


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return OUT.format(q=dict(queries.dtypes)["query_id"], v=dict(vectors.dtypes)["id"])


def similarities(vectors: DataFrame, queries: DataFrame, threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity) of queries against vectors.

    Without a threshold every pair has a row; its similarity is NULL where a
    vector has no length.  NULL embeddings have no rows.
    """
    return _similarities(vectors, queries, None, threshold)


def _similarities(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None) -> DataFrame:
    """The same; with ``k`` at least each query's best k, and more the more blocks there are.

    Up to MAX_QUERIES queries (counted) travel with the tasks and the vectors
    stay where they are.  More queries are cut into blocks and so are the
    vectors; every pair of blocks becomes one group of bounded size.
    """
    schema = _schema(vectors, queries)
    vectors, queries = (d.where(F.col("embedding").isNotNull()) for d in (vectors, queries))
    sample = queries.select("query_id", "embedding").limit(MAX_QUERIES + 1).toPandas()
    if len(sample) <= MAX_QUERIES:
        if sample.empty:
            return vectors.sparkSession.createDataFrame([], schema)
        q_ids, q_unit = sample["query_id"].to_numpy(), _unit(sample["embedding"])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _pairs(q_ids, q_unit, batch["id"].to_numpy(), _unit(batch["embedding"]), k, threshold)

        return vectors.select("id", "embedding").mapInPandas(scan, schema)

    q_blocks = -(-queries.count() // MAX_QUERIES)
    v_blocks = -(-vectors.count() // BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = vectors.select("id", "embedding", block("id", v_blocks).alias("vb"), every(q_blocks).alias("qb"))
    right = queries.select("query_id", "embedding", block("query_id", q_blocks).alias("qb"), every(v_blocks).alias("vb"))

    def score(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return _pairs(
            q["query_id"].to_numpy(), _unit(q["embedding"]), v["id"].to_numpy(), _unit(v["embedding"]), k, threshold
        )

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(score, schema)


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """The k most similar vectors per query, above the threshold; ties by id."""
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    partial = _similarities(vectors, queries, k, threshold)
    return partial.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def nearest_query(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Each vector with its most similar query, the smallest of equals."""
    pairs = similarities(vectors, queries)
    distance = F.struct((-F.col("similarity")).isNull().alias("none"), (-F.col("similarity")).alias("d"), "query_id")
    best = pairs.groupBy("id").agg(F.min_by(F.struct("query_id", "similarity"), distance).alias("_b"))
    return best.select("id", "_b.query_id", "_b.similarity")


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(query_id, embedding): the mean vector of each group.

    Averages are taken per dimension before anything is gathered; what is
    gathered per group is one number per dimension.
    """
    parts = vectors.select(F.col(group).alias("query_id"), F.posexplode("embedding").alias("dim", "v"))
    means = parts.groupBy("query_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("embedding")
    )


def chunks(docs: DataFrame, key: str, text: str, size: int = 1000) -> DataFrame:
    """(key, chunk, text): the whole text in consecutive pieces of ``size``."""
    cut = docs.where(F.length(text) > 0).select(
        key, text, F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).alias("_at")
    )
    return cut.select(
        key,
        (F.col("_at") / size).cast("int").alias("chunk"),
        F.substring(F.col(text), F.col("_at") + 1, F.lit(size)).alias("text"),
    )


def concatenate(pages: DataFrame, key: str, page: str, text: str, per_part: int | None = None) -> DataFrame:
    """(key, part, text): pages joined in order, one row per document.

    With ``per_part`` a document continues in a further part after so many
    page numbers, which bounds the length of a row.
    """
    part = F.floor(F.col(page) / per_part) if per_part else F.lit(0)
    parts = pages.withColumn("part", part.cast("int"))
    joined = parts.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("_p")
    )
    return joined.select(key, "part", F.array_join(F.transform("_p", lambda s: s["t"]), "\n").alias("text"))


class Clustering(NamedTuple):
    """Members (id, cluster; NULL for vectors without a direction) and centres (cluster, centre of length one)."""

    members: DataFrame
    centres: DataFrame


def _by_rows(units: pd.Series | pa.ListArray) -> np.ndarray:
    """A batch of vectors as the rows of a matrix; an Arrow column is not copied."""
    if isinstance(units, pd.Series):
        return np.vstack(units.to_list())
    lengths = pc.list_value_length(units).to_numpy(zero_copy_only=False)
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors differ in length")
    return units.flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1)


def product_rows(centres: int) -> int:
    """Vectors in one matrix product against so many centres."""
    return max(1, min(NEAREST_ROWS, PRODUCT_CELLS // max(1, centres)))


class _Centres:
    """Centres of length one, and the place of the most similar one for unit vectors.

    Products are taken in single precision; where the second best comes so close
    that rounding may have decided, they are taken again in double precision, so
    the place is that of the double products.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.narrow = rows, np.ascontiguousarray(rows.T, dtype=np.float32)
        self.doubt = (rows.shape[1] + 2) * 2.0**-22  # at least twice what rounding can do to two products

    def places(self, units: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(units), dtype=np.int32), product_rows(len(self.rows))
        for first in range(0, len(units), step):
            x = units[first : first + step]
            likeness, every = x.astype(np.float32) @ self.narrow, np.arange(len(x))
            best = likeness.argmax(axis=1)
            top = likeness[every, best].copy()
            likeness[every, best] = -np.inf
            close = np.nonzero(likeness.max(axis=1) >= top - self.doubt)[0]
            if len(close):
                best[close] = np.argmax(x[close] @ self.rows.T, axis=1)
            out[first : first + step] = best
        return out


def _nearest(centres: np.ndarray) -> Callable[[Column], Column]:
    """The place of the most similar centre of a unit vector."""
    known = _Centres(centres)

    @F.pandas_udf("int")
    def of(units: pd.Series) -> pd.Series:
        return pd.Series(known.places(_by_rows(units)) if len(units) else [], dtype="int32")

    return of


def _summed(label: np.ndarray, rows: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
    """Add the rows of each label to its sum in ``s``, their number to ``n``."""
    order = np.argsort(label, kind="stable")
    found, first, count = np.unique(label[order], return_index=True, return_counts=True)
    n[found] += count
    s[found] += np.add.reduceat(rows[order], first, axis=0)


def _sums(units: DataFrame, at: np.ndarray, seeds: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the unit vectors at each centre, then of those at each seed.

    A vector belongs to its most similar centre; if that centre owns seeds (``owner``
    in order), to the most similar of them instead.  A task hands on one sum for each
    place it has met, in pieces, and the pieces of all tasks are added up.
    """
    known, k, every = _Centres(at), len(at), len(at) + len(seeds)
    split, begin, many = np.unique(owner, return_index=True, return_counts=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(every, dtype=np.int64), np.zeros((every, at.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _by_rows(batch.column("unit"))
            label = known.places(x)
            inside = np.nonzero(np.isin(label, split))[0]
            if len(inside):
                inside = inside[np.argsort(label[inside], kind="stable")]
                own, first, count = np.unique(label[inside], return_index=True, return_counts=True)
                for c, i, j in zip(np.searchsorted(split, own), first, count):
                    rows = inside[i : i + j]
                    label[rows] = k + begin[c] + np.argmax(x[rows] @ seeds[begin[c] : begin[c] + many[c]].T, axis=1)
            _summed(label, x, n, s)
        met = np.nonzero(n)[0]
        if len(met):
            cuts = [p for p in np.split(met, np.nonzero(np.diff(met // PIECE))[0] + 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(p[0]) // PIECE for p in cuts], pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()),
                    pa.array([p.tobytes() for p in cuts], pa.binary()),
                    pa.array([n[p].tobytes() for p in cuts], pa.binary()),
                    pa.array([s[p].tobytes() for p in cuts], pa.binary()),
                ],
                ["piece", "task", "places", "n", "s"],
            )

    def merged(found: pd.DataFrame) -> pd.DataFrame:
        base = int(found["piece"].iloc[0]) * PIECE
        n, s = np.zeros(PIECE, dtype=np.int64), np.zeros((PIECE, at.shape[1]))
        for r in found.sort_values("task").itertuples():  # always in the same order: sums of doubles depend on it
            places = np.frombuffer(r.places, dtype=np.int64) - base
            n[places] += np.frombuffer(r.n, dtype=np.int64)
            s[places] += np.frombuffer(r.s).reshape(len(places), -1)
        return pd.DataFrame({"piece": [base // PIECE], "n": [n.tobytes()], "s": [s.tobytes()]})

    parts = units.select("unit").mapInArrow(scan, "piece int, task int, places binary, n binary, s binary")
    whole = parts.groupBy("piece").applyInPandas(merged, "piece int, n binary, s binary").collect()  # a row for PIECE centres
    n, s = np.zeros(every + PIECE, dtype=np.int64), np.zeros((every + PIECE, at.shape[1]))
    for r in whole:
        here = slice(r["piece"] * PIECE, (r["piece"] + 1) * PIECE)
        n[here], s[here] = np.frombuffer(r["n"], dtype=np.int64), np.frombuffer(r["s"]).reshape(PIECE, -1)
    return n[:every], s[:every]


def clustering(vectors: DataFrame, limit: int, most_clusters: int | None = None, seed: int = 42) -> Clustering:
    """Spherical k-means with so many clusters that each has fewer than ``limit`` vectors.

    k starts at the number that even sizes would need, with members drawn by a
    digest of their id as first centres.  Each round moves the centres a few
    times; then a cluster that is still too large is parted into as many pieces
    as its size asks for: members drawn from it part the others among them, and
    the means of the pieces take its centre's place.  (A drawn member alone would
    hardly keep another vector, and sizes would fall by one a round.)  So k grows only where it
    must, all oversized clusters at once, and the rounds with the logarithm of
    their sizes.  Once all are below the limit the centres go on moving while
    they change and the limit holds.  k is not shown to be the smallest: that
    takes a whole fit for every k tried.

    A vector is in the cluster of its most similar centre among all.  A round
    is a few passes of matrix products whose sums are added up; the driver holds the
    centres, a row per cluster.  NULL and zero vectors belong to no cluster.
    Raises ValueError when no clustering into up to ``most_clusters``, or up to
    the number of vectors, is found; copies cannot be told apart, so ``limit``
    of them have none.
    """
    wide = F.col("embedding").cast("array<double>")
    length = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)
    unit = let(F.sqrt(length), lambda norm: F.transform(wide, lambda x: x / norm))
    spark = vectors.sparkSession
    found = vectors.where(length > 0).select("id", unit.alias("unit"), F.xxhash64("id", F.lit(seed)).alias("draw"))
    # dealt evenly: the work is in the products, not in the bytes
    able = cut_lineage(found.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "id"))
    lost = vectors.where(~F.coalesce(length > 0, F.lit(False))).select("id", F.lit(None).cast("int").alias("cluster"))
    total = able.count()
    most = min(total, most_clusters or total)
    if total == 0:
        return Clustering(able.select("id", F.lit(0).alias("cluster")).unionByName(lost), spark.createDataFrame([], CENTRES))

    def drawn(asked: dict[int, int], members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """So many members of each cluster of ``asked``, and their clusters, in order."""
        sizes = spark.createDataFrame(list(asked.items()), "cluster int, asked int")
        slots = members.join(F.broadcast(sizes), "cluster").withColumn("slot", F.pmod("draw", "asked"))
        picked = slots.groupBy("cluster", "slot").agg(F.min_by("unit", F.struct("draw", "id")).alias("unit"))
        rows = picked.orderBy("cluster", "slot").collect()
        return np.array([r["unit"] for r in rows]), np.array([r["cluster"] for r in rows], dtype=np.int64)

    def distinct(rows: np.ndarray) -> np.ndarray:
        _, first = np.unique(np.round(rows, 12), axis=0, return_index=True)
        return rows[np.sort(first)]

    def placed(at: np.ndarray) -> DataFrame:
        return able.withColumn("cluster", _nearest(at)("unit"))

    def directions(sums: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        return np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), otherwise)

    def facts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each cluster's size and the direction of its mean; where there is none the centre stays."""
        sizes, sums = _sums(able, at, at[:0], np.zeros(0, dtype=np.int64))
        return sizes, directions(sums, at)

    def pieces(asked: dict[int, int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The directions of the pieces into which drawn members part each cluster of ``asked``, and their clusters."""
        seeds, owner = drawn(asked, placed(at))
        sizes, sums = _sums(able, at, seeds, owner)
        taken = np.nonzero(sizes[len(at) :])[0]
        return directions(sums[len(at) :], seeds)[taken], owner[taken]

    def fail() -> ValueError:
        return ValueError(f"no clustering into up to {most} clusters has all of them below {limit}")

    k = -(-total // max(1, limit - 1))  # fewer clusters cannot all be small enough
    if k > most:
        raise fail()
    at = distinct(drawn({0: k}, able.withColumn("cluster", F.lit(0)))[0])
    moves, best = 0, None
    sizes, middle = facts(at)
    while best is None:
        for _ in range(MOVES):
            if sizes.max() < limit or moves >= MOST_MOVES or np.allclose(at, middle):
                break
            at, moves = middle[sizes > 0], moves + 1
            sizes, middle = facts(at)
        if sizes.max() < limit:
            best = at, sizes, middle
            break
        room, asked = most - len(at), {}
        for c in np.argsort(-sizes, kind="stable").tolist():
            extra = min(room, -(-int(sizes[c]) // max(1, limit - 1)) - 1)
            if sizes[c] >= limit and extra > 0:
                asked[c], room = extra, room - extra
        if not asked:
            raise fail()
        made, owner = pieces({c: n + 1 for c, n in asked.items()}, at)
        # what has one piece, because all drawn are alike, keeps its centre
        whole = np.isin(np.arange(len(at)), owner[np.isin(owner, np.nonzero(np.bincount(owner) > 1)[0])], invert=True)
        wider = distinct(np.vstack([at[whole], made[~whole[owner]]]))
        if len(wider) <= len(at):
            asked = {c: 2 * n + 2 for c, n in asked.items()}
            wider = distinct(np.vstack([at, _others(placed(at), at, asked, most - len(at))]))
            if len(wider) == len(at):
                raise fail()
        at = wider
        sizes, middle = facts(at)
    while moves < MOST_MOVES and not np.allclose(best[0], best[2]):
        at, moves = best[2][best[1] > 0], moves + 1
        sizes, middle = facts(at)
        if sizes.max() >= limit:
            break
        best = at, sizes, middle
    at = best[0][best[1] > 0]
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], CENTRES)
    return Clustering(cut_lineage(placed(at).select("id", "cluster")).unionByName(lost), centres)


def _others(placed: DataFrame, at: np.ndarray, clusters: Iterable[int], most: int) -> np.ndarray:
    """Of each of ``clusters`` the member least like its centre, if it is no copy of it; at most ``most``."""

    @F.pandas_udf("double")
    def likeness(units: pd.Series, cluster: pd.Series) -> pd.Series:
        return pd.Series((np.vstack(units.to_list()) * at[cluster.to_numpy()]).sum(axis=1)) if len(units) else pd.Series([], dtype=float)

    near = placed.where(F.col("cluster").isin(list(clusters))).withColumn("likeness", likeness("unit", "cluster"))
    far = near.groupBy("cluster").agg(F.min_by("unit", F.struct("likeness", "draw", "id")).alias("unit"), F.min("likeness").alias("least"))
    rows = far.where(F.col("least") < 1 - 1e-12).orderBy("least", "cluster").limit(max(0, most)).collect()
    return np.array([r["unit"] for r in rows]).reshape(len(rows), at.shape[1])


def cluster(vectors: DataFrame, limit: int, most_clusters: int | None = None, seed: int = 42) -> DataFrame:
    """The members of ``clustering``: (id, cluster)."""
    return clustering(vectors, limit, most_clusters, seed).members
