"""Lattice hashing of embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.llm import lattice


def brute(rows, least):
    def good(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n, links, name = len(rows), [0] * len(rows), list(range(len(rows)))
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if good(r) else None for r in rows]
    edges = []
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            low = min(name[i], name[j])
            if name[i] != low or name[j] != low:
                name[i] = name[j] = low
                changed = True
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[name[i]] = min(lowest.get(name[i], r[0]), r[0])
    return sorted((str(r[0]), links[i], str(lowest.get(name[i])), r[0] == lowest.get(name[i])) for i, r in enumerate(rows))


def fixture():
    draw = np.random.default_rng(5)
    rows, key = [], 0

    def add(v, label):
        nonlocal key
        rows.append((key, None if v is None else [None if x is None else float(x) for x in v], label))
        key += 1

    for label in (0, 1, 2):
        for centre in draw.normal(size=(12, 24)):
            add(centre, label)
            for spread in (0.02, 0.05, 0.1, 0.3, 0.6):
                add(centre + spread * draw.normal(size=24), label)
    crowd = draw.normal(size=24)
    for _ in range(120):
        add(crowd + 0.12 * draw.normal(size=24), 1)
    for _ in range(20):
        add(crowd, 1)
    add(crowd * 3, 1)
    add(crowd, 2)
    add(crowd, None)
    add(crowd[:10], 1)
    add(crowd[:10] * 2, 1)
    for odd in (None, [], np.zeros(24), [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23):
        add(odd, 1)
    rows += [(None, [1.0, 0.0], 9), (None, [1.0, 0.0], 8), (3, rows[3][1], rows[3][2])]
    return rows


@pytest.mark.parametrize("block", [2_000, 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit("x")).withColumn("kept", F.lit(1)).repartition(4)
    got = lattice.near_duplicates(df, lattice=lattice.Lattice(tables=10)).collect()
    want = brute(rows, 0.93)
    mine = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["vec_id"] == r["component_id"]) for r in got)
    assert sum(w[1] for w in want) > 5_000
    assert mine == want


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(9)
    a = draw.normal(size=(1_500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.935
    pairs = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(pairs)], "vec_id long, embedding array<float>, label int")
    linked = lattice.near_duplicates(df).where("n_links > 0").count()
    assert linked / len(pairs) >= 0.95


def test_nearest_point_is_the_nearest():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 8)) * 2
    near = lattice.nearest_point(x)
    assert np.all(near.sum(axis=1) % 2 == 0) and np.all((near % 1).min(axis=1) == (near % 1).max(axis=1))
    best = ((x - near) ** 2).sum(axis=1)
    around = ((x[:, None, :] - near[:, None, :] - lattice.SHORTEST[None]) ** 2).sum(axis=2).min(axis=1)
    assert np.all(best <= around + 1e-12) and best.max() <= 1 + 1e-12
    assert len(lattice.SHORTEST) == 240 and np.allclose((lattice.SHORTEST**2).sum(axis=1), 2)


def test_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_groups_of_copies_just_below_the_bound_stay_apart(spark):
    """Two groups of equal vectors whose cosine is a little below or at the bound, by less than an angle's rounding."""
    rows = []
    for g, gap in enumerate((-3e-9, 3e-9, -2e-8, 2e-8)):
        c = 0.93 + gap
        a, b = np.zeros(64), np.zeros(64)
        a[2 * g], b[2 * g], b[2 * g + 1] = 1.0, c, np.sqrt(1 - c * c)
        rows += [(100 * g + i, a.tolist(), g) for i in range(5)] + [(100 * g + 50 + i, b.tolist(), g) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df).collect()}
    for vec_id, _, g in rows:
        assert got[vec_id] == (9 if g % 2 else 4), (vec_id, got[vec_id])
