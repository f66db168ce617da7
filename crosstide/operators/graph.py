"""Neighbourhood queries on a graph of nodes (id, label, content) and edges (src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators import lookups
from crosstide.session import cut_lineage, shuffle_width

HUB_EDGES = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Each connection once, smaller id first; no self loops."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ).distinct()


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per (content, label), with the smallest id."""
    return nodes.groupBy("content", "label").agg(F.min("id").alias("id"))


def _neighbours(frontier: DataFrame, edges: DataFrame, hub_edges: int) -> DataFrame:
    """Join a frontier (seed, node) with edges on the node.

    A short frontier is broadcast (it was counted).  A long one is shuffled,
    with the edges of hub nodes split by their other end and the frontier rows
    on hubs repeated once per split; hubs number at most edges / hub_edges.
    """
    if frontier.limit(lookups.BROADCAST_ROWS + 1).count() <= lookups.BROADCAST_ROWS:
        return edges.join(F.broadcast(frontier), edges.src == frontier.node).select("seed", "dst")
    hubs = (
        edges.groupBy("src")
        .agg(F.ceil(F.count(F.lit(1)) / hub_edges).cast("int").alias("_parts"))
        .where(F.col("_parts") > 1)
    )
    cut = edges.join(F.broadcast(hubs), "src", "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts")), F.lit(0))
    )
    spread = (
        frontier.join(F.broadcast(hubs.withColumnRenamed("src", "node")), "node", "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .select("seed", F.col("node").alias("src"), F.col("_part").cast("long").alias("_part"))
    )
    return cut.join(spread, ["src", "_part"]).select("seed", "dst")


def within_steps(
    edges: DataFrame,
    seeds: DataFrame,
    steps: int,
    nodes: DataFrame | None = None,
    labels: Sequence[str] | None = None,
    block: bool = False,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """(seed, node, distance): nodes other than the seed at most ``steps`` away
    along ``edges`` (pass ``both_ways(...)`` for an undirected graph).

    ``labels`` filters the result; with ``block`` the walk itself only enters
    nodes of those labels.  Each hop is written down, so the plan does not grow.

    Seeds with the same neighbours reach the same nodes at the same distances,
    but for themselves (a way back through the seed only leads to where it
    began).  So one walk serves them all, and its rows meet the seeds in the
    result only: what is stored grows with the groups of such seeds.
    """
    walk = edges.select("src", "dst")
    if labels is not None:
        allowed = nodes.where(F.col("label").isin(list(labels))).select(F.col("id").alias("dst"))
        if block:
            walk = walk.join(allowed, "dst", "left_semi").select("src", "dst")
    walk = cut_lineage(walk)
    start = seeds.select(F.col("node").alias("seed"), "node").distinct()
    first = cut_lineage(_neighbours(start, walk, hub_edges).where(F.col("seed") != F.col("dst")).withColumnRenamed("dst", "node").distinct())
    members = cut_lineage(_alike(first))
    visited = cut_lineage(
        first.join(members.select("group").distinct().withColumnRenamed("group", "seed"), "seed", "left_semi")
        .select(F.col("seed").alias("group"), "node", F.lit(1).alias("distance"))
    )
    frontier = visited.select(F.col("group").alias("seed"), "node")
    for step in range(2, steps + 1):
        onward = walk
        if labels is not None and step == steps:  # the last step need not enter what the result leaves out
            onward = walk.join(allowed, "dst", "left_semi").select("src", "dst")
        reached = _neighbours(frontier, onward, hub_edges).select(F.col("seed").alias("group"), F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(reached.join(visited, ["group", "node"], "left_anti").withColumn("distance", F.lit(step)))
        visited = visited.unionByName(fresh)
        frontier = fresh.select(F.col("group").alias("seed"), "node")
    found = visited if steps > 0 else visited.limit(0)
    if labels is not None:
        found = found.join(allowed.withColumnRenamed("dst", "node"), "node", "left_semi")
    return _spread(found, members).where(F.col("node") != F.col("seed")).select("seed", "node", "distance")


def _alike(first: DataFrame) -> DataFrame:
    """(seed, group): seeds with the same neighbours share a group, the smallest seed among them.

    Digests propose the groups.  A seed then stays in one only if each of its
    neighbours is one of the group's smallest seed and there are as many, so
    equal digests of different sets part again.
    """
    digest = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    sets = first.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), digest.alias("h"))
    groups = sets.groupBy("n", "h").agg(F.min("seed").alias("group"))
    proposed = cut_lineage(sets.join(groups, ["n", "h"]).select("seed", "group", "n"))
    lead = proposed.select("group").distinct().withColumnRenamed("group", "seed")
    of_lead = first.join(lead, "seed", "left_semi").select(F.col("seed").alias("group"), "node")
    same = first.join(proposed, "seed").join(of_lead, ["group", "node"]).groupBy("seed").agg(F.count(F.lit(1)).alias("shared"))
    whole = F.col("shared") == F.col("n")
    return proposed.join(same, "seed", "left").select("seed", F.when(whole, F.col("group")).otherwise(F.col("seed")).alias("group"))


def _spread(found: DataFrame, members: DataFrame) -> DataFrame:
    """What each group reached, for every seed of it; the rows of one group are shared by many tasks."""
    width = shuffle_width(found.sparkSession)
    if lookups.is_small(members):
        return found.repartition(width, "group", "node").join(F.broadcast(members), "group")
    return lookups.lookup_many(found, members, "group", ["node"])


def ancestry(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, ancestor, generations): everything each node descends from along
    ``edges`` (src child, dst parent), by the shortest line, at most ``most``
    generations up.

    Lines double: those of up to 2n generations are two of up to n joined, so
    the rounds grow with the logarithm of the depth.  Each round is written
    down.  Shortest lines only shrink, so a cycle ends too; a node is no
    ancestor of itself.  NULL ends are ignored.
    """
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).distinct()
    known = cut_lineage(steps.withColumn("generations", F.lit(1)))
    reach, last = 1, None
    while most is None or reach < most:
        facts = known.agg(F.count(F.lit(1)), F.sum("generations")).first()
        if facts == last:
            break
        last = facts
        upper = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("generations").alias("more"))
        longer = known.join(upper, "ancestor").select("node", F.col("beyond").alias("ancestor"), (F.col("generations") + F.col("more")).alias("generations"))
        longer = longer.where(F.col("node") != F.col("ancestor"))
        if most is not None:
            longer = longer.where(F.col("generations") <= most)
        known = cut_lineage(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("generations").alias("generations")))
        reach *= 2
    return known


def shared_neighbours(reached: DataFrame, least: int = 2) -> DataFrame:
    """Nodes reached from at least ``least`` seeds, with the number of seeds."""
    return reached.groupBy("node").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least)


def common_to_all(reached: DataFrame, seeds: int) -> DataFrame:
    return shared_neighbours(reached, seeds).select("node")


def passes_distance(
    reached: DataFrame, distances: DataFrame, limit: float, near: bool = False
) -> DataFrame:
    """Keep a seed's result only if one of its nodes passes the distance test.

    ``distances`` is (node, distance_to_constraint).  By default a node passes
    when it lies beyond the limit; ``near`` asks for within.
    """
    gap = F.col("distance_to_constraint")
    ok = gap <= limit if near else gap > limit
    good = (
        reached.join(distances, "node")
        .where(ok)
        .select("seed")
        .distinct()
    )
    return reached.join(good, "seed", "left_semi")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


# -- attempt traces ---------------------------------------------------------------

def clean_traces(attempts: DataFrame, last: int | None = None) -> DataFrame:
    """Drop failures that follow a success, keep the last n attempts per task.

    Attempts are (task, attempt, success).  A failure survives exactly when it
    comes before the task's first success, which is one aggregate per task.
    """
    first = attempts.groupBy("task").agg(
        F.min(F.when(F.col("success"), F.col("attempt"))).alias("_first")
    )
    kept = lookups.lookup(attempts, first, ["task"], ["task", "attempt"]).where(
        F.col("success") | F.col("_first").isNull() | (F.col("attempt") < F.col("_first"))
    ).drop("_first")
    if last is None:
        return kept
    newest = Window.partitionBy("task").orderBy(F.col("attempt").desc())
    return kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def repeated_failures(attempts: DataFrame, limit: int) -> DataFrame:
    """Tasks never solved after at least ``limit`` attempts."""
    return (
        attempts.groupBy("task")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("_won"))
        .where((F.col("attempts") >= limit) & (F.col("_won") == 0))
        .drop("_won")
    )


def balanced_top(df: DataFrame, query: str, order: str, verified: str, limit: int) -> DataFrame:
    """At most ``limit`` rows per query: just over half verified where there are
    that many, the rest from the others, each class in its own order."""
    sure = F.coalesce(F.col(verified), F.lit(False))  # an unknown class is not verified
    place = Window.partitionBy(query, sure).orderBy(order)
    head = df.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit)
    counts = df.groupBy(query).agg(F.count_if(sure).alias("_yes"), F.count_if(~sure).alias("_no"))
    quota = F.greatest(F.least(F.lit(limit // 2 + 1), F.col("_yes")), F.lit(limit) - F.col("_no"))
    taken = F.when(sure, quota).otherwise(F.lit(limit) - quota)
    return lookups.lookup(head, counts, [query], [query, order]).where(F.col("_n") <= taken).drop("_n", "_yes", "_no")
