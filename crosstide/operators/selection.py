"""Choosing trajectories from an evolution pool.

A pool has trajectory_id, seq (insertion order, unique), direction_id,
round_idx, phase, metric and parent_ids.  Groups of parents are formed only
among candidates whose number depends on how many groups are asked for, never
on the pool; each function says why no better group can be missed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import div
from crosstide.operators import groups, ranking
from crosstide.operators.lookups import with_row
from crosstide.session import cut_lineage

ORIGINAL, MUTATION, CROSSOVER = "original", "mutation", "crossover"


def uniform(seed: int, *columns: str) -> Column:
    """A repeatable uniform number in (0, 1] per row, the same on every retry."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return (bits + 1) / F.lit(float(2**48))


def by_merit() -> list[Column]:
    return [F.coalesce("metric", F.lit(0.0)).desc(), F.col("seq")]


def by_direction(pool: DataFrame, direction: int) -> DataFrame:
    return pool.where(F.col("direction_id") == direction)


def by_phase(pool: DataFrame, phase: str) -> DataFrame:
    return pool.where(F.col("phase") == phase)


def mutation_parents(pool: DataFrame) -> DataFrame:
    """Per direction the trajectory of the highest round, the earliest on ties."""
    best = pool.groupBy("direction_id").agg(
        F.max_by(F.struct(*pool.columns), F.struct("round_idx", -F.col("seq"))).alias("_p")
    )
    return best.select("_p.*")


def _facts(pool: DataFrame) -> DataFrame:
    """One row: latest mutation round, latest and second latest crossover round."""
    latest = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("round_idx")))
    tops = pool.agg(latest(MUTATION).alias("_mut"), latest(CROSSOVER).alias("_cross"))
    earlier = (F.col("phase") == CROSSOVER) & (F.col("round_idx") < F.col("_cross"))
    second = with_row(pool, tops).agg(
        F.first("_mut").alias("_mut"),
        F.first("_cross").alias("_cross"),
        F.max(F.when(earlier, F.col("round_idx"))).alias("_before"),
    )
    return second


def mutation_targets(pool: DataFrame, current_round: int) -> DataFrame:
    """Originals in round one, else the latest crossover round; without any
    crossover, the previous round."""
    if current_round == 1:
        return by_phase(pool, ORIGINAL)
    known = with_row(pool, _facts(pool))
    chosen = F.when(
        F.col("_cross").isNotNull(), (F.col("phase") == CROSSOVER) & (F.col("round_idx") == F.col("_cross"))
    ).otherwise(F.col("round_idx") == current_round - 1)
    return known.where(chosen).drop("_mut", "_cross", "_before")


def crossover_candidates(pool: DataFrame, mutation_enabled: bool = True) -> DataFrame:
    """Members of the two most recent relevant rounds."""
    known = with_row(pool, _facts(pool))
    phase, round_ = F.col("phase"), F.col("round_idx")
    no_cross = F.col("_cross").isNull()
    latest_cross = F.coalesce((phase == CROSSOVER) & (round_ == F.col("_cross")), F.lit(False))
    if mutation_enabled:
        latest_mut = F.coalesce((phase == MUTATION) & (round_ == F.col("_mut")), F.lit(False))
        chosen = latest_mut | F.when(no_cross, phase == ORIGINAL).otherwise(latest_cross)
    else:
        before = F.coalesce((phase == CROSSOVER) & (round_ == F.col("_before")), F.lit(False))
        older = F.when(F.col("_before").isNull(), phase == ORIGINAL).otherwise(before)
        chosen = latest_cross | older
    return known.where(chosen).drop("_mut", "_cross", "_before")


def top_n(pool: DataFrame, n: int) -> DataFrame:
    return pool.orderBy(*by_merit()).limit(n)


def successful(pool: DataFrame) -> DataFrame:
    return pool.where(F.col("metric") > 0)


def groups_of(candidates: DataFrame, size: int, most: int) -> DataFrame:
    """All groups of ``size`` from at most ``most`` ranked candidates.

    The only caller-visible bound is ``most``; candidates are already limited
    to it, so ranking them in one task and pairing by rank is bounded work.
    """
    order = Window.orderBy(*by_merit())
    ranked = candidates.withColumn("place", F.row_number().over(order)).select(
        "place", F.struct("trajectory_id", "direction_id", "phase", "metric", "seq").alias("member")
    )
    groups = ranked.select(F.array("place").alias("places"), F.array("member").alias("members"))
    for _ in range(size - 1):
        last = F.element_at("places", -1)
        steps = groups.where(last < most).withColumn("place", F.explode(F.sequence(last + 1, F.lit(most))))
        groups = steps.join(ranked, "place").select(
            F.array_append("places", F.col("place")).alias("places"),
            F.array_append("members", F.col("member")).alias("members"),
        )
    return groups


def _ids(members: str) -> Column:
    return F.transform(members, lambda m: m["trajectory_id"])


def _directions(members: str) -> Column:
    return F.size(F.array_distinct(F.transform(members, lambda m: m["direction_id"])))


STRATEGIES = ("best", "random", "weighted", "weighted_inverse", "top_percent_plus_random")


def preselected(
    pool: DataFrame, strategy: str, need: int, share: float = 0.3, seed: int = 0
) -> DataFrame:
    """The trajectories that may become parents: ``need`` of them, or the whole
    ``share`` where the strategy guarantees it and it is larger."""
    if strategy == "best":
        return top_n(pool, need)
    if strategy == "random":
        drawn = pool.withColumn("_u", uniform(seed, "trajectory_id"))
        return drawn.orderBy("_u", "seq").limit(need).drop("_u")
    if strategy in ("weighted", "weighted_inverse"):
        return weighted_sample(pool, need, seed, inverse=strategy.endswith("inverse"))
    if strategy == "top_percent_plus_random":
        return top_share_and_random(pool, share, need, seed)
    raise ValueError(f"unknown strategy {strategy!r}; choose from {STRATEGIES}")


def diverse_groups(
    pool: DataFrame,
    size: int = 2,
    n: int = 3,
    strategy: str = "best",
    share: float = 0.3,
    seed: int = 0,
    prefer_diverse: bool = True,
) -> DataFrame:
    """Best groups by 2 * directions + phases + mean metric among the
    ``n * size`` trajectories a strategy selects (or the whole share of the
    top-percent strategy); random groups of these without ``prefer_diverse``.

    No strategy forms the groups it does not return: see ``operators.groups``.
    """
    chosen = preselected(pool, strategy, n * size, share, seed)
    if strategy == "top_percent_plus_random":
        chosen = cut_lineage(chosen)
    if not prefer_diverse:
        return groups.drawn_groups(chosen, size, n, seed)
    return groups.top_groups(chosen, size, n)


def best_groups(pool: DataFrame, size: int = 2, n: int = 3) -> DataFrame:
    """The n groups with the largest metric sum.

    Trajectories without a metric join only when too few have one.
    """
    enough = pool.agg(F.count("metric").alias("_scored"))
    usable = with_row(pool, enough).where(
        F.col("metric").isNotNull() | (F.col("_scored") < size)
    ).drop("_scored")
    most = n + size - 1  # a group with any other member has n replacements for it
    return groups.top_groups(top_n(usable, most), size, n, groups.Score(direction=0.0, phase=0.0, mean=False))


def cross_direction_pairs(pool: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    return cross_direction_groups(pool, 2, n, seed)


def cross_direction_groups(pool: DataFrame, size: int = 2, n: int = 3, seed: int = 0) -> DataFrame:
    """The first n groups spanning several directions, in rank order, filled up
    at random with other groups when the pool has fewer.

    Candidates are the n + size - 1 best of each of the n + 1 directions with
    the best leaders.  A group reaching past them comes, in rank order, after n
    groups inside them: the first groups share their first members, and either
    any further member crosses, or the n best of other directions do.
    """
    scored = pool.where(F.col("metric").isNotNull())
    inside = Window.partitionBy("direction_id").orderBy(*by_merit())
    leaders = (
        scored.groupBy("direction_id")
        .agg(F.max(F.struct("metric", (-F.col("seq")).alias("s"))).alias("_lead"))
        .orderBy(F.col("_lead").desc())
        .limit(n + 1)
    )
    candidates = (
        scored.withColumn("_place", F.row_number().over(inside))
        .where(F.col("_place") < n + size)
        .join(F.broadcast(leaders), "direction_id", "left_semi")
        .drop("_place")
    )
    pairs = groups_of(candidates, size, (n + 1) * (n + size - 1)).select(
        _ids("members").alias("ids"), (_directions("members") > 1).alias("crossed"), "places"
    )
    luck = F.when(F.col("crossed"), F.lit(0.0)).otherwise(uniform_of(seed))
    return pairs.orderBy(F.col("crossed").desc(), luck, "places").limit(n)


def uniform_of(seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.array_join("ids", "|")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48))


def weighted_sample(pool: DataFrame, n: int, seed: int = 0, inverse: bool = False) -> DataFrame:
    """n trajectories without replacement, weight = scaled metric + 0.1.

    Drawing one by one with renormalised weights has the same law as taking the
    n smallest of -ln(u) / weight, which is one pass and a top-n.
    """
    value = F.coalesce("metric", F.lit(0.0))
    span = pool.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.coalesce(div(value - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    weight = (1 - scaled if inverse else scaled) + 0.1
    wait = -F.ln(uniform(seed, "trajectory_id")) / weight
    return (
        with_row(pool, span)
        .withColumn("_wait", wait)
        .orderBy("_wait", "seq")
        .limit(n)
        .drop("_low", "_high", "_wait")
    )


def top_share_and_random(
    pool: DataFrame, share: float, n: int, seed: int = 0, hot_rows: int = ranking.HOT_ROWS
) -> DataFrame:
    """The best ``share`` of the pool, filled at random to n from the rest.

    The share grows with the pool, so it is cut by exact distributed ranks: by
    metric, and inside the one metric value the cut falls on by ``seq``.
    """
    spots = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    scored = pool.withColumns({"_all": F.lit(1), "_v": -F.coalesce("metric", F.lit(0.0))})
    places = ranking.value_positions(scored, ["_all"], "_v", hot_rows)
    edge = places.where((F.col("below") < spots) & (spots < F.col("below") + F.col("ties"))).select(
        "_v", "_all", (spots - F.col("below")).alias("_take")
    )
    full = places.where(F.col("below") + F.col("ties") <= spots).agg(F.max("_v").alias("_full"))
    on_edge = scored.join(F.broadcast(edge), ["_all", "_v"])
    order = ranking.value_positions(on_edge, ["_all"], "seq", hot_rows).select(
        "seq", F.col("below").alias("_nth")
    )
    edge_top = on_edge.join(order, "seq").where(F.col("_nth") < F.col("_take")).select("seq")
    sure = with_row(scored, full).where(F.col("_v") <= F.col("_full")).select("seq")
    top = sure.unionByName(edge_top).withColumn("_top", F.lit(True))
    marked = pool.join(top, "seq", "left").withColumn("_top", F.coalesce("_top", F.lit(False)))
    kept = marked.where("_top").drop("_top")
    needed = F.lit(n) - F.col("_have")
    have = top.agg(F.count(F.lit(1)).alias("_have"))
    drawn = (
        marked.where(~F.col("_top"))
        .drop("_top")
        .withColumn("_u", uniform(seed, "trajectory_id"))
        .orderBy("_u", "seq")
        .limit(n)
    )
    numbered = drawn.withColumn("_nth", F.row_number().over(Window.orderBy("_u", "seq")))
    extra = with_row(numbered, have).where(F.col("_nth") <= needed)
    return kept.unionByName(extra.select(*kept.columns))


def bernoulli(df: DataFrame, rate: float, seed: int, *key: str) -> DataFrame:
    """Each row kept with probability ``rate``, the same rows on every retry."""
    return df.where(uniform(seed, *key) <= rate)


def best_so_far(pool: DataFrame, decision: str) -> DataFrame:
    """The most recent accepted experiment."""
    return pool.where(F.col(decision)).agg(
        F.max_by(F.struct(*pool.columns), F.struct("round_idx", "seq")).alias("_b")
    ).select("_b.*")


def pool_statistics(pool: DataFrame) -> DataFrame:
    """Counts by phase, by direction and overall, in one grouping-sets pass."""
    level = (
        F.when(F.grouping("phase") == 0, "phase")
        .when(F.grouping("direction_id") == 0, "direction")
        .otherwise("all")
    )
    return pool.groupingSets(
        [[F.col("phase")], [F.col("direction_id")], []], F.col("phase"), F.col("direction_id")
    ).agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("trajectories"),
        F.count_if(F.col("metric") > 0).alias("successful"),
        F.max("round_idx").alias("latest_round"),
    )


def parent_edges(pool: DataFrame) -> DataFrame:
    """(src child, dst parent), one row per recorded parent."""
    return pool.select(F.col("trajectory_id").alias("src"), F.explode("parent_ids").alias("dst"))
