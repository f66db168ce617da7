"""Groups of parents: the best ones by a score of their classes and metrics, or drawn ones.

A group's score adds a weight per distinct direction, a weight per distinct
phase, and the total or mean metric.  All but the metric depends on the members'
*classes* (direction, phase) alone, which bounds the search by the request and
never by the pool:

* A member below the best ``n + size - 1`` of its class has ``n`` better unused
  stand-ins of the same class, so ``n`` better groups exist.
* The members of one direction in a group are a *block* with a signature (how
  many of each phase).  A direction below the best ``n + size - 1`` of a
  signature has ``n`` better unused directions that stand in for the block.

What stays, at most signatures x phases x (n + size - 1)^2 rows, is searched
best first in one task.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.ranking import numbered


@dataclass(frozen=True)
class Score:
    """What a distinct direction and a distinct phase add, and whether the metric counts as mean or total."""

    direction: float = 2.0
    phase: float = 1.0
    mean: bool = True


def _key():
    """Rows in order of merit; equal keys cannot occur, ``seq`` being unique."""
    return F.struct((-F.coalesce("metric", F.lit(0.0))).alias("m"), F.col("seq").alias("s"))


def class_leaders(pool: DataFrame, size: int, n: int) -> DataFrame:
    """The rows of ``pool`` that can be in one of the ``n`` best groups of ``size``, whatever the weights.

    Both cuts are top-k windows, which Spark limits in every task before it
    shuffles, so a class with a third of the pool sends ``n + size - 1`` rows
    per task.  The distinct phases (a handful) reach the driver.
    """
    most = n + size - 1
    mine = Window.partitionBy("direction_id", "phase").orderBy("_key")
    ranked = pool.withColumn("_key", _key()).withColumn("_nth", F.row_number().over(mine)).where(F.col("_nth") <= most)
    phases = [r[0] for r in pool.select("phase").distinct().orderBy("phase").collect()]
    cell = {
        (p, i): F.max(F.when(F.col("phase").eqNullSafe(phase) & (F.col("_nth") == i), F.col("_key"))).alias(f"c{p}_{i}")
        for p, phase in enumerate(phases)
        for i in range(1, size + 1)
    }
    if not cell:
        return pool
    wide = ranked.groupBy("direction_id").agg(*cell.values())
    blocks = []
    for count in range(1, size + 1):
        for phases_of in combinations_with_replacement(range(len(phases)), count):
            taken = [F.col(f"c{p}_{i}") for p in set(phases_of) for i in range(1, phases_of.count(p) + 1)]
            members = F.array_sort(F.array(*taken))
            total = F.aggregate(members, F.lit(0.0), lambda acc, k: acc + k["m"])
            whole = F.array_contains(F.transform(F.array(*taken), lambda k: k.isNull()), True)
            name = F.lit(",".join(map(str, phases_of)))
            blocks.append(F.when(~whole, F.struct(name.alias("signature"), F.struct(total.alias("t"), members.alias("k")).alias("block"))))
    each = wide.select("direction_id", F.explode(F.array_compact(F.array(*blocks))).alias("_b")).select("direction_id", "_b.*")
    best = Window.partitionBy("signature").orderBy("block", "direction_id")
    kept = each.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= most).select(F.col("direction_id").alias("_d")).distinct()
    return ranked.join(F.broadcast(kept), F.col("direction_id").eqNullSafe(F.col("_d")), "left_semi").drop("_key", "_nth")


def best_first(direction: np.ndarray, phase: np.ndarray, metric: np.ndarray, size: int, n: int, score: Score) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best (score, members), members being places in the given order of merit.

    Equal scores go to the group whose places come first.  A node of the search
    is the beginning of a group; its bound assumes that every further member is
    the next best one and brings a new direction and a new phase.  Metrics are
    added in order of merit in bounds and scores alike, so a bound is never
    below a score, not even by rounding, and equal metrics give equal numbers.
    """
    count = len(metric)
    if size > count or n < 1:
        return []
    divisor = size if score.mean else 1
    all_phases = len(set(phase.tolist()))
    found: list[tuple[float, tuple[int, ...]]] = []  # (-score, places) of the best groups so far

    def offer(groups: list[tuple[float, tuple[int, ...]]]) -> None:
        found[:] = heapq.nsmallest(n, [*found, *groups])

    def children(places: tuple[int, ...], total: float) -> Iterator[tuple[float, tuple[int, ...], float]]:
        start = places[-1] + 1 if places else 0
        left = size - len(places) - 1
        end = count - left
        if start >= end:
            return
        totals = total + metric[start:end]
        best = totals.copy()
        for i in range(left):
            best += metric[start + 1 + i : end + 1 + i]
        old_d, old_p = set(direction[list(places)].tolist()), set(phase[list(places)].tolist())
        fresh_d = ~np.isin(direction[start:end], list(old_d))
        fresh_p = ~np.isin(phase[start:end], list(old_p))
        directions = len(old_d) + fresh_d + left
        phases = np.minimum(len(old_p) + fresh_p + left, all_phases)
        bound = score.direction * directions + score.phase * phases + best / divisor
        if len(found) == n:
            able = np.flatnonzero(bound >= -found[-1][0])
        else:
            able = np.arange(len(bound))
        if not left and len(able) > n:  # complete groups: the best n, ties to the first places
            able = np.sort(able[np.argsort(-bound[able], kind="stable")[:n]])
        for i in able.tolist():
            yield -float(bound[i]), (*places, start + i), float(totals[i])

    queue: list[tuple[float, tuple[int, ...], float]] = [(-math.inf, (), 0.0)]
    while queue:
        bound, places, total = heapq.heappop(queue)
        if len(found) == n and found[-1] < (bound, places):
            break  # all that is left comes later
        if len(places) == size - 1:
            offer([(s, p) for s, p, _ in children(places, total)])
        else:
            for child in children(places, total):
                heapq.heappush(queue, child)
    return [(-s, p) for s, p in found]


def top_groups(pool: DataFrame, size: int, n: int, score: Score = Score()) -> DataFrame:
    """(ids, score, places): the ``n`` best groups of ``size`` rows of ``pool``, best first by (score, places).

    ``pool`` has trajectory_id, seq (unique), direction_id, phase and metric;
    NULL metrics count 0, NULL directions and phases are classes of their own.
    ``places`` are ranks by merit among the rows that were searched.  Fewer
    rows than ``size`` give an empty table.
    """
    kind = dict(pool.dtypes)["trajectory_id"]
    few = class_leaders(pool, size, n).select(
        "trajectory_id", F.col("direction_id").cast("string").alias("d"), F.col("phase").cast("string").alias("p"), F.coalesce("metric", F.lit(0.0)).alias("m"), "seq"
    )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["m", "seq"], ascending=[False, True], kind="stable")
        classes = [pd.factorize(rows[c], use_na_sentinel=False)[0] for c in ("d", "p")]
        groups = best_first(*classes, rows["m"].to_numpy(dtype="float64"), size, n, score)
        if not groups:
            return
        names = rows["trajectory_id"].tolist()
        yield pd.DataFrame(
            {
                "ids": [[names[i] for i in places] for _, places in groups],
                "score": [s for s, _ in groups],
                "places": [[i + 1 for i in places] for _, places in groups],
            }
        )

    return few.repartition(1).mapInPandas(search, f"ids array<{kind}>, score double, places array<int>")


def drawn_groups(pool: DataFrame, size: int, n: int, seed: int = 0) -> DataFrame:
    """(ids, score NULL, places): ``n`` different groups of ``size`` rows of ``pool``, each as likely as any other.

    Places are drawn on the driver (``n * size`` numbers) and joined to the
    rows numbered by merit; no other group is ever formed.
    """
    rows = numbered(pool.select("trajectory_id", "seq", _key().alias("_key")), "place", F.col("_key"))
    total = rows.count()
    ways = math.comb(total, size)
    draw = random.Random(seed)
    if ways <= 4 * n:
        groups = draw.sample(list(combinations(range(1, total + 1), size)), min(n, ways))
    else:
        picked: dict[tuple[int, ...], None] = {}
        while len(picked) < n:
            places = sorted({draw.randrange(total) + 1 for _ in range(size)})
            if len(places) == size:
                picked[tuple(places)] = None
        groups = list(picked)
    wanted = pool.sparkSession.createDataFrame([(g, p) for g, places in enumerate(groups) for p in places], "g long, place long")
    met = rows.join(F.broadcast(wanted), "place").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("place", "trajectory_id"))).alias("m"))
    return met.select(
        F.transform("m", lambda x: x["trajectory_id"]).alias("ids"),
        F.lit(None).cast("double").alias("score"),
        F.transform("m", lambda x: x["place"].cast("int")).alias("places"),
    )
