"""Exact cosine search that leaves most vectors unread.

Every vector is filed under its nearest *pivot* and a ring of angles round it.
For a query at angle a from a pivot, no vector in the ring [low, high] can be
nearer than max(a - high, low - a) (triangle inequality of angles).  A first
pass reads the nearest rings with k vectors; its k-th similarity bounds the
answer, and a second pass reads only the rings that can hold a nearer vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.vectors import BLOCK_ROWS, MAX_QUERIES, _pairs, _schema, _unit
from crosstide.session import cut_lineage, scratch_path

#: Pivots of an index, and rings a half turn is cut into; both bound what the driver holds.
PIVOTS, RINGS = 64, 160
#: Far above the rounding of angles and similarities.
SLACK = 1e-6


class Index(NamedTuple):
    """Filed vectors (pivot, ring, block, id, embedding), stored; their rings (pivot, ring, low, high, n, blocks); the pivots."""

    rows: DataFrame
    rings: pd.DataFrame
    pivots: np.ndarray


class Found(NamedTuple):
    """(query_id, id, similarity, place), and (query_id, scanned): how many vectors were compared with the query."""

    best: DataFrame
    scanned: DataFrame


def build(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, seed: int = 0, block_rows: int = BLOCK_ROWS) -> Index:
    """Files (id, embedding) by nearest pivot and angle; NULL and zero vectors are nowhere near anything.

    Pivots are ``pivots`` rows drawn by a digest of the id.  A ring with more
    than ``block_rows`` vectors is dealt into blocks.  Rows are stored sorted by
    pivot and ring, so a reader skips the files' parts it does not ask for.
    """
    spark = vectors.sparkSession
    length = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    able = vectors.where(length > 0).select("id", "embedding")
    drawn = able.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots).toPandas()
    kinds = dict(able.dtypes)
    schema = f"pivot int, ring int, angle double, id {kinds['id']}, embedding {kinds['embedding']}"
    if drawn.empty:
        return Index(spark.createDataFrame([], schema + ", block int"), pd.DataFrame(columns=["pivot", "ring", "low", "high", "n", "blocks"]), np.zeros((0, 0)))
    centre = _unit(drawn["embedding"])

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                dots = _unit(batch["embedding"]) @ centre.T
                pivot = dots.argmax(axis=1)
                angle = np.arccos(np.clip(dots[np.arange(len(batch)), pivot], -1.0, 1.0))
                ring = np.minimum((angle / math.pi * rings).astype(int), rings - 1)
                yield pd.DataFrame({"pivot": pivot, "ring": ring, "angle": angle, "id": batch["id"], "embedding": batch["embedding"]})

    filed = cut_lineage(able.mapInPandas(file, schema))
    sizes = filed.groupBy("pivot", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    table = sizes.toPandas()  # pivots * rings rows at most
    table["blocks"] = np.ceil(table["n"] / block_rows).astype(int)
    parts = F.broadcast(spark.createDataFrame(table[["pivot", "ring", "blocks"]], "pivot int, ring int, blocks int"))
    laid = filed.join(parts, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    path = scratch_path(spark, "pivots")
    laid = laid.select("pivot", "ring", "block", "id", "embedding").repartitionByRange("pivot", "ring", "block", "id")
    laid.sortWithinPartitions("pivot", "ring").write.parquet(path)
    return Index(spark.read.parquet(path), table, centre)


def _asked(index: Index, queries: DataFrame, k: int, bounded: bool, first: DataFrame | None = None) -> DataFrame:
    """(query_id, q, pivot, ring, block): the parts each query has to read."""
    table, pivots = index.rings, index.pivots
    low, high, n, blocks = (table[c].to_numpy() for c in ("low", "high", "n", "blocks"))
    pivot, ring = table["pivot"].to_numpy(dtype=int), table["ring"].to_numpy(dtype=int)
    kinds = dict(queries.dtypes)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, unit in zip(batch.itertuples(index=False), _unit(batch["embedding"]) if len(batch) else [], strict=True):
                angle = np.arccos(np.clip(pivots @ unit, -1.0, 1.0))[pivot]
                nearest = np.maximum(np.maximum(angle - high, low - angle), 0.0)
                order = np.argsort(nearest, kind="stable")
                start = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                taken = start
                if bounded:
                    inside = np.flatnonzero(nearest <= row.reach + SLACK)
                    taken = np.setdiff1d(inside, start)
                for i in taken.tolist():
                    out += [(row.query_id, row.embedding, int(pivot[i]), int(ring[i]), b, int(n[i])) for b in range(int(blocks[i]))]
            yield pd.DataFrame(out, columns=["query_id", "q", "pivot", "ring", "block", "n"])

    source = queries.join(first, "query_id") if bounded else queries
    schema = f"query_id {kinds['query_id']}, q {kinds['embedding']}, pivot int, ring int, block int, n long"
    return cut_lineage(source.mapInPandas(choose, schema))


def _compared(index: Index, asked: DataFrame, k: int, threshold: float, schema: str) -> DataFrame:
    """Each part's best k for the queries that read it; many queries of a part come in blocks."""
    parts = ["pivot", "ring", "block"]
    crowd = cut_lineage(asked.groupBy(*parts).agg(F.ceil(F.count(F.lit(1)) / MAX_QUERIES).cast("int").alias("qs")))  # pivots * rings * blocks rows
    wanted = asked.join(F.broadcast(crowd.toDF(*parts, "queries")), parts).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("queries")).cast("int"))
    read = index.rows.join(F.broadcast(crowd), parts).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))

    def score(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return _pairs(q["query_id"].to_numpy(), _unit(q["q"]), v["id"].to_numpy(), _unit(v["embedding"]), k, threshold)

    keys = [*parts, "qb"]
    read, wanted = read.select(*keys, "id", "embedding"), wanted.select(*[F.col(c).alias(c) for c in keys], "query_id", "q")
    return read.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(score, schema)


def top_similar(index: Index, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> Found:
    """The rows of ``vectors.top_similar``, and how many vectors each query was compared with.

    NULL and zero queries find nothing; repeated query ids must be the same query.
    """
    schema = _schema(index.rows, queries)
    length = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    able = queries.where(length > 0).select("query_id", "embedding").dropDuplicates(["query_id"])
    if not len(index.rings):
        none = queries.sparkSession.createDataFrame([], schema + ", place int")
        return Found(none, able.select("query_id", F.lit(0).cast("long").alias("scanned")))
    near = _asked(index, able, k, False)
    start = cut_lineage(_compared(index, near, k, threshold, schema))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    place = F.row_number().over(best)
    kth = start.withColumn("place", place).where(F.col("place") == k).select("query_id", F.acos("similarity").alias("reach"))
    widest = math.acos(max(-1.0, min(1.0, threshold)))
    reach = able.select("query_id").join(kth, "query_id", "left").select("query_id", F.coalesce("reach", F.lit(widest)).alias("reach"))
    further = _asked(index, able, k, True, reach)
    both = start.unionByName(_compared(index, further, k, threshold, schema))
    asked = near.unionByName(further).where("block = 0").groupBy("query_id").agg(F.sum("n").alias("scanned"))
    return Found(both.withColumn("place", place).where(F.col("place") <= k), asked)
