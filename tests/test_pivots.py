"""Pruned search against the plain one."""

import numpy as np
import pytest

from crosstide.operators import pivots, vectors


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 8).tolist()) for i in range(2000)]
    rows += [(3000 + i, rows[7][1]) for i in range(30)] + [(4000, [0.0] * 16), (4001, None)]
    return spark.createDataFrame(rows, "id int, embedding array<double>").repartition(6).cache()


def found(df):
    return sorted((r.query_id, r.place, r.id, r.similarity) for r in df.collect())


@pytest.mark.parametrize("k,threshold,block_rows", [(5, 0.0, 50_000), (12, 0.9, 20), (40, -1.0, 7), (5, 0.9999999, 50_000)])
def test_same_rows_from_few_vectors(spark, clustered, k, threshold, block_rows):
    queries = clustered.where("id % 100 = 7 OR id >= 4000").selectExpr("id AS query_id", "embedding")
    index = pivots.build(clustered, block_rows=block_rows)
    got = pivots.top_similar(index, queries, k, threshold)
    assert found(got.best) == found(vectors.top_similar(clustered, queries, k, threshold))
    scanned = {r.query_id: r.scanned for r in got.scanned.collect()}
    assert len(scanned) == 21 and sum(scanned.values()) < 0.25 * 2030 * 21


def test_nothing_to_find(spark, clustered):
    none = clustered.limit(0)
    queries = clustered.where("id = 7").selectExpr("id AS query_id", "embedding")
    assert pivots.top_similar(pivots.build(none), queries, 5).best.count() == 0
    assert pivots.top_similar(pivots.build(clustered), queries.limit(0), 5).best.count() == 0
