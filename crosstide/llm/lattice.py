"""Near-duplicate embeddings by E8 lattice hashing.

Vectors are projected at random to eight dimensions, several times, and each
projection is decoded to the nearest point of the E8 lattice.  Vectors whose
lattice points are equal or neighbours are candidates; cosine decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import components, runs, written

#: Vectors of one cell that form groups together, at most about.
BLOCK = 2_000
#: Above the error of an angle worked out from a cosine near 1 (1.5e-8), so only verified pairs lie near the bound.
EPS = 1e-7


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or eight of size 1/2 with an even number of minus signs."""
    out = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1.0, -1.0), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = a, b
        out.append(v)
    halves = (np.array(s) for s in product((0.5, -0.5), repeat=8))
    return np.array(out + [h for h in halves if (h < 0).sum() % 2 == 0])


SHORTEST = shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: round, and if the sum is odd turn the worst coordinate the other way."""
    near = np.rint(x)
    rest, row = x - near, np.arange(len(x))
    worst = np.abs(rest).argmax(axis=1)
    other = near.copy()
    other[row, worst] += np.where(rest[row, worst] >= 0, 1.0, -1.0)
    return np.where((near.sum(axis=1) % 2 != 0)[:, None], other, near)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even integer points and of those shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@dataclass(frozen=True)
class Lattice:
    """Tables, neighbour cells probed in each, and cells per unit length.

    A linked pair at cosine 0.93 shares or neighbours a cell with probability
    0.6 a table, at 0.96 with 0.78, so four tables miss about two in a hundred
    at worst.  For many more vectors per label raise ``scale`` and ``tables``.
    """

    tables: int = 4
    probes: int = 16
    scale: float = 0.85
    seed: int = 11

    def cells(self, unit: np.ndarray, tables: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(own cell, probed cells) of unit vectors as integers, for each table."""
        n, own, near = len(unit), [], []
        for t in range(self.tables if tables is None else tables):
            deal = np.random.default_rng([self.seed, t, unit.shape[1]]).normal(size=(unit.shape[1], 8))
            x = unit @ deal * self.scale
            point = nearest_point(x)
            own.append(_packed(point, t))
            if tables is None and self.probes:
                gain = (x - point) @ SHORTEST.T
                best = np.argpartition(-gain, min(self.probes, 239), axis=1)[:, : self.probes]
                near.append(_packed((point[:, None, :] + SHORTEST[best]).reshape(-1, 8), t).reshape(n, -1))
        return np.stack(own, axis=1), np.concatenate(near, axis=1) if near else np.zeros((n, 0), dtype=np.int64)


def _packed(points: np.ndarray, t: int) -> np.ndarray:
    """One integer per lattice point and table (a clash only makes a candidate more)."""
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    out = np.full(len(points), t + 1, dtype=np.uint64)
    for i in range(8):
        out = (out ^ twice[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = vectors.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, unit(np.stack(vectors.iloc[at].to_numpy()))


def _own_cell(vector: Column, lattice: Lattice) -> Column:
    @F.pandas_udf("long")
    def of(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), dtype=np.int64)
        for at, x in _by_length(vectors):
            out[at] = lattice.cells(x, 1)[0][:, 0]
        return pd.Series(out)

    return of(vector)


def _all_cells(vector: Column, lattice: Lattice) -> Column:
    @F.pandas_udf("struct<own:array<long>,near:array<long>>")
    def of(vectors: pd.Series) -> pd.DataFrame:
        own: list = [None] * len(vectors)
        near: list = [None] * len(vectors)
        for at, x in _by_length(vectors):
            for i, a, b in zip(at.tolist(), *lattice.cells(x), strict=True):
                own[i], near[i] = a, b
        return pd.DataFrame({"own": own, "near": near})

    return of(vector)


def _cosine(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left))
        for at, x in _by_length(left):
            out[at] = np.einsum("ij,ij->i", x, unit(np.stack(right.iloc[at].to_numpy())))
        return pd.Series(out)

    return of(a, b)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


def _grouped(reach: float):
    """Groups of a cell's vectors, each within ``reach`` (an angle) of its leader, the first vector left."""
    limit = math.cos(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            x, ids = _vectors(rows["v"]), rows["rid"].to_numpy()
            group, cosine = np.full(len(ids), -1, dtype=np.int64), np.ones(len(ids))
            left = np.arange(len(ids))
            while len(left):
                c = x[left] @ x[left[0]]
                near = c >= limit
                near[0] = True
                group[left[near]], cosine[left[near]] = ids[left[0]], np.minimum(c[near], 1.0)
                left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(group), pa.array(cosine)], ["rid", "gid", "c"])

    return run


def _members_met(least: float):
    """Links between the members of two groups: for every member how many vectors of the other group it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 2):
            x, ids, weight, side = _vectors(rows["v"]), rows["rid"].to_numpy(), rows["w"].to_numpy(), rows["side"].to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            met = x[a] @ x[b].T >= least
            n = np.concatenate([met @ weight[b], met.T @ weight[a]])
            who, some = ids[np.concatenate([a, b])], n > 0
            g = [np.full(int(some.sum()), rows[c][0].as_py(), dtype=np.int64) for c in ("g1", "g2")]
            yield pa.RecordBatch.from_arrays([pa.array(g[0]), pa.array(g[1]), pa.array(who[some]), pa.array(n[some].astype(np.int64))], ["g1", "g2", "rid", "n"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, lattice: Lattice = Lattice()) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component_id``, ``kept``.

    Rows are compared only if their labels are equal and not NULL and their
    vectors have one length.  Vectors that are NULL, empty, zero, or hold a
    NULL or non-finite component link with nothing.  Every row counts as a
    vector of its own, so repeated rows link with each other.  No found link
    is below ``least`` (cosine in double precision); the lattice may miss some
    (see ``Lattice``).  ``component_id`` is the smallest key reachable.  NULL
    keys stay NULL in ``component_id`` unless linked to a keyed row, and are
    kept if it is NULL.  An empty table gives an empty result; other columns
    are ignored.

    Equal vectors are one representative with a weight.  Representatives of a
    cell form groups within half the link angle of a leader: inside a group
    all are linked without being paired.  Tables bring together pairs of
    groups, never of vectors.  By the triangle inequality most pairs of groups
    link wholly or not at all; only the rest compare their members, as matrix
    blocks that return counts.  A cell with more than ``BLOCK`` vectors is cut
    by a hash, so no task holds one cell, and no step lists a group's pairs.
    """
    theta = math.acos(least)
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("l").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    usable = rows.where(fit).select("k", F.concat_ws(":", F.col("l").cast("string"), F.size("v").cast("string")).alias("lab"), "v")
    reps = usable.groupBy("lab", "v").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("w"))
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()).withColumn("cell", _own_cell(F.col("v"), lattice)), "vectors")

    crowded = reps.groupBy("lab", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    dealt = reps.join(crowded, ["lab", "cell"], "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / BLOCK)), F.lit(0)))
    ordered = dealt.select("lab", "cell", "part", "rid", "v").repartition("lab", "cell", "part").sortWithinPartitions("lab", "cell", "part", "rid")
    grouped = ordered.mapInArrow(_grouped(theta / 2 - EPS), "rid long, gid long, c double")
    members = written(reps.join(grouped, "rid"), "members")
    leaders = members.where("rid = gid").select("gid", "lab", "v")
    size = members.groupBy("gid").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("reps"), F.acos(F.min("c")).alias("radius"), F.min("first").alias("first"))
    groups = written(leaders.join(size, "gid"), "groups")

    cells = written(members.select("gid", "lab", _all_cells(F.col("v"), lattice).alias("c")).select("gid", "lab", "c.own", "c.near"), "cells")
    place = F.xxhash64("lab", "cell").alias("key")
    own = cells.select("gid", "lab", F.explode("own").alias("cell")).select(F.col("gid").alias("a"), place).distinct()
    asked = cells.select("gid", "lab", F.explode(F.concat("own", "near")).alias("cell")).select(F.col("gid").alias("b"), place).distinct()
    met = own.join(asked, "key").where("a <> b").select(F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).distinct()
    one = groups.select(F.col("gid").alias("g1"), F.col("lab").alias("l1"), F.col("v").alias("v1"), F.col("radius").alias("r1"), F.col("reps").alias("n1"), F.col("weight").alias("w1"))
    two = groups.select(F.col("gid").alias("g2"), F.col("lab").alias("l2"), F.col("v").alias("v2"), F.col("radius").alias("r2"), F.col("reps").alias("n2"), F.col("weight").alias("w2"))
    pairs = met.join(one, "g1").join(two, "g2").where("l1 = l2").withColumn("c", _cosine(F.col("v1"), F.col("v2"))).drop("v1", "v2", "l1", "l2")
    angle, spread = F.acos(F.greatest(F.least("c", F.lit(1.0)), F.lit(-1.0))), F.col("r1") + F.col("r2")
    alone = (F.col("n1") == 1) & (F.col("n2") == 1)
    kind = F.when(alone, F.when(F.col("c") >= least, "all")).when(angle + spread <= theta - EPS, "all").when(angle - spread <= theta + EPS, "some")
    pairs = written(pairs.withColumn("kind", kind).where("kind IS NOT NULL").select("g1", "g2", "w1", "w2", "kind"), "pairs")

    whole, some = pairs.where("kind = 'all'"), pairs.where("kind = 'some'")
    sides = some.select("g1", "g2", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("g1").alias("gid")), F.struct(F.lit(1).alias("side"), F.col("g2").alias("gid")))))
    blocks = sides.join(members.select("gid", "rid", "w", "v"), "gid").select("g1", "g2", "side", "rid", "w", "v")
    checked = blocks.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "rid").mapInArrow(_members_met(least), "g1 long, g2 long, rid long, n long")
    checked = written(checked, "checked")

    links = whole.select("g1", "g2").unionAll(checked.select("g1", "g2").distinct())
    joined = components(links).select(F.col("node").alias("gid"), "component")
    by_group = whole.select(F.col("g1").alias("gid"), F.col("w2").alias("n")).unionAll(whole.select("g2", "w1")).groupBy("gid").agg(F.sum("n").alias("others"))
    placed = groups.select("gid", "weight", "first").join(joined, "gid", "left").join(by_group, "gid", "left")
    placed = written(placed.select("gid", "weight", "first", F.coalesce("component", "gid").alias("component"), F.coalesce("others", F.lit(0)).alias("others")), "placed")
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(names, "component").select("gid", "component_id", (F.col("weight") - 1 + F.col("others")).alias("base"))
    by_member = checked.groupBy("rid").agg(F.sum("n").alias("more"))
    told = members.select("rid", "gid", "lab", "v").join(placed, "gid").join(by_member, "rid", "left")
    told = written(told.select("lab", "v", "component_id", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_links")), "told")

    linked = usable.join(told, ["lab", "v"]).select("k", "n_links", "component_id")
    rest = rows.where(~fit).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionAll(rest).select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
