"""Group search against all groups of small pools."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.operators import groups, selection

COLUMNS = "trajectory_id string, seq long, direction_id long, round_idx int, phase string, metric double"


def merit(rows):
    return sorted(rows, key=lambda r: (-(r[5] or 0.0), r[1]))


def brute(rows, size, n, direction=2.0, phase=1.0, mean=True):
    ordered, scored = merit(rows), []
    for places in combinations(range(len(ordered)), size):
        members = [ordered[i] for i in places]
        total = 0.0
        for m in members:
            total += m[5] or 0.0
        score = direction * len({m[2] for m in members}) + phase * len({m[4] for m in members}) + total / (size if mean else 1)
        scored.append((-score, places, [m[0] for m in members]))
    return [(ids, -s) for s, _, ids in sorted(scored)[:n]]


def random_pool(draw, rows, directions, metrics):
    return [
        (f"t{i}", i, draw.choice(directions), i % 3, draw.choice(["original", "mutation", "crossover", None][: draw.randint(1, 4)]), draw.choice(metrics))
        for i in range(rows)
    ]


@pytest.mark.parametrize("size,n", [(1, 4), (2, 3), (2, 12), (3, 5), (4, 3)])
def test_search_equals_all_groups(size, n):
    draw = random.Random(size * 100 + n)
    for _ in range(60):
        metrics = draw.choice([[0.1, 0.2, 0.3], [None, 0.1], [-5.0, 0.5, 9.0, 40.0], [0.7]])
        rows = merit(random_pool(draw, draw.randint(0, 14), draw.choice([[1], [1, 2], list(range(9))]), metrics))
        code = lambda i: np.array([hash((i, r[i])) for r in rows], dtype=np.int64)
        values = np.array([r[5] or 0.0 for r in rows], dtype=np.float64)
        for score in (groups.Score(), groups.Score(0.0, 0.0, False)):
            got = groups.best_first(code(2), code(4), values, size, n, score)
            assert [([rows[i][0] for i in p], s) for s, p in got] == brute(rows, size, n, score.direction, score.phase, score.mean)


@pytest.mark.parametrize("seed,size,n", [(1, 2, 4), (2, 3, 3), (3, 2, 2)])
def test_leaders_of_classes_suffice(spark, seed, size, n):
    draw = random.Random(seed)
    rows = random_pool(draw, 90, [1, 1, 1, 2, 3, *range(4, 30), None], [0.1, 0.2, 0.3, None, 7.0, -2.0, 0.25])
    pool = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = [(r["ids"], r["score"]) for r in sorted(groups.top_groups(pool, size, n).collect(), key=lambda r: (-r["score"], r["places"]))]
    assert got == brute(rows, size, n)
    everything = selection.diverse_groups(pool, size, n, "top_percent_plus_random", share=1.0)
    assert sorted(r["ids"] for r in everything.collect()) == sorted(ids for ids, _ in got)


def test_a_million_rows_form_no_combinations(spark):
    big = spark.range(1_000_000).select(
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("trajectory_id"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5_000).alias("direction_id"),
        F.lit(0).alias("round_idx"),
        F.element_at(F.array(F.lit("original"), F.lit("mutation"), F.lit("crossover")), (F.col("id") % 3 + 1).cast("int")).alias("phase"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1e6).alias("metric"),
    )
    assert groups.class_leaders(big, 3, 4).count() <= 19 * 3 * 6 * 6
    got = selection.diverse_groups(big, 3, 4, "top_percent_plus_random", share=0.3).collect()
    assert len(got) == 4 and all(r["score"] > 9.99 for r in got)
    drawn = selection.diverse_groups(big, 3, 5, "top_percent_plus_random", share=0.3, prefer_diverse=False).collect()
    assert len({tuple(r["ids"]) for r in drawn}) == 5 and max(r["places"][-1] for r in drawn) <= 300_000


def test_drawn_groups_of_a_small_pool(spark):
    rows = [(f"t{i}", i, 1, 0, "original", i / 10) for i in range(4)]
    pool = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r["ids"] for r in groups.drawn_groups(pool, 2, 99).collect()) == sorted([f"t{b}", f"t{a}"] for a, b in combinations(range(4), 2))
    assert groups.drawn_groups(pool, 5, 3).count() == 0 and groups.top_groups(pool.limit(0), 2, 3).count() == 0
    assert groups.top_groups(pool, 5, 3).count() == 0
