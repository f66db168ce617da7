"""Evolution-pool selection, customers as trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.common import r, register, rs, table
from crosstide.operators import graph, selection
from crosstide.session import scratch_path
from crosstide.sources import stores

TEXT = {
    "trajectory_id": "('t' || CAST(c_custkey AS STRING))",
    "seq": "c_custkey",
    "direction_id": "c_nationkey",
    "round_idx": "CAST(c_custkey % 5 AS INT)",
    "phase": "CASE WHEN c_custkey % 5 = 0 THEN 'original' WHEN c_custkey % 5 IN (1, 3) THEN 'mutation' ELSE 'crossover' END",
    "metric": "CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal / 100000.0 END",
    "decision": "c_mktsegment = 'BUILDING' AND c_acctbal > 0",
}
COLS = ["trajectory_id", "direction_id", "round_idx", "phase"]


def pool(spark, sf):
    """Parents lie one round earlier: the key before, and for crossovers the
    one six before as well."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("t"), k.cast("string"))
    mother = F.when(key % 5 > 0, name(key - 1))
    father = F.when((key % 5).isin(2, 4) & (key >= 6), name(key - 6))
    return table(spark, sf, "customer").select(
        *[F.expr(e).alias(c) for c, e in TEXT.items()],
        F.array_compact(F.array(mother, father)).alias("parent_ids"),
    )


POOL_SQL = "pool AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TEXT.items()) + " FROM customer)"
MERIT = "coalesce(metric, 0) DESC, seq"


def add(name, query, sql=None, *more) -> None:
    register(name, query, None if sql is None else "WITH " + ",".join([POOL_SQL, *more]) + " " + sql)


C = ", ".join(COLS)


def s13(spark, sf):
    path = scratch_path(spark, "pool")
    rows = pool(spark, sf).select(
        "trajectory_id", "direction_id", "round_idx", "phase",
        F.array(F.struct(F.col("trajectory_id").alias("name"), F.lit("$close").alias("expression"), F.lit("").alias("description"))).alias("factors"),
        F.create_map(F.lit("RankIC"), "metric").alias("backtest_metrics"), "parent_ids",
    )
    stores.save_pool(rows, path)
    return stores.load_pool(spark, path).select(
        *COLS, r(F.try_element_at("backtest_metrics", F.lit("RankIC"))).alias("metric"),
        F.col("factors")[0]["expression"].alias("expression"), F.size("parent_ids").alias("parents"),
    )


add("s13_trajectory_pool", s13,
    f"SELECT {C}, {rs('metric')} AS metric, '$close' AS expression, CAST(CASE WHEN round_idx = 0 THEN 0 WHEN round_idx IN (2, 4) AND seq >= 6 THEN 2 ELSE 1 END AS INT) AS parents FROM pool")
add("r01_by_direction_phase",
    lambda spark, sf: selection.by_phase(selection.by_direction(pool(spark, sf), 3), "mutation").select(*COLS),
    f"SELECT {C} FROM pool WHERE direction_id = 3 AND phase = 'mutation'")
add("r02_mutation_parents", lambda spark, sf: selection.mutation_parents(pool(spark, sf)).select(*COLS),
    f"SELECT {C} FROM pool QUALIFY row_number() OVER (PARTITION BY direction_id ORDER BY round_idx DESC, seq) = 1")


def r03(spark, sf):
    p = pool(spark, sf)
    tag = lambda df, t: df.select(F.lit(t).alias("case"), *COLS)
    return (
        tag(selection.mutation_targets(p, 1), "first")
        .unionByName(tag(selection.mutation_targets(p, 3), "later"))
        .unionByName(tag(selection.mutation_targets(p.where("phase <> 'crossover'"), 4), "no crossover"))
    )


add("r03_mutation_targets", r03,
    f"SELECT 'first' AS \"case\", {C} FROM pool WHERE phase = 'original' UNION ALL "
    f"SELECT 'later', {C} FROM pool WHERE phase = 'crossover' AND round_idx = (SELECT max(round_idx) FROM pool WHERE phase = 'crossover') UNION ALL "
    f"SELECT 'no crossover', {C} FROM pool WHERE phase <> 'crossover' AND round_idx = 3")


def r04(spark, sf):
    p = pool(spark, sf)
    tag = lambda df, t: df.select(F.lit(t).alias("case"), *COLS)
    early = p.where("phase <> 'crossover'")
    return (
        tag(selection.crossover_candidates(p), "standard")
        .unionByName(tag(selection.crossover_candidates(early), "first"))
        .unionByName(tag(selection.crossover_candidates(p, False), "crossover only"))
        .unionByName(tag(selection.crossover_candidates(early, False), "first, crossover only"))
    )


MAXR = "(SELECT max(round_idx) FROM pool WHERE phase = '{0}')"
add("r04_crossover_candidates", r04,
    f"SELECT 'standard' AS \"case\", {C} FROM pool WHERE phase IN ('mutation', 'crossover') AND round_idx = CASE phase WHEN 'mutation' THEN {MAXR.format('mutation')} ELSE {MAXR.format('crossover')} END UNION ALL "
    f"SELECT 'first', {C} FROM pool WHERE phase = 'original' OR (phase = 'mutation' AND round_idx = {MAXR.format('mutation')}) UNION ALL "
    f"SELECT 'crossover only', {C} FROM pool WHERE phase = 'crossover' AND round_idx IN (2, 4) UNION ALL "
    f"SELECT 'first, crossover only', {C} FROM pool WHERE phase = 'original'")

PAIR = (
    "a.trajectory_id || '+' || b.trajectory_id"
)
SCORE = "2 * CASE WHEN a.direction_id = b.direction_id THEN 1 ELSE 2 END + CASE WHEN a.phase = b.phase THEN 1 ELSE 2 END + (coalesce(a.metric, 0) + coalesce(b.metric, 0)) / 2"
RANKED = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {MERIT}) AS place FROM pool)"
shown = lambda df: df.select(F.array_join("ids", "+").alias("ids"), r("score").alias("score"))
add("r05_diverse_pairs", lambda spark, sf: shown(selection.diverse_groups(pool(spark, sf), 2, 10)),
    f"SELECT {PAIR} AS ids, {rs(SCORE)} AS score FROM ranked a JOIN ranked b ON a.place < b.place AND b.place <= 20 ORDER BY {SCORE} DESC, a.place, b.place LIMIT 10", RANKED)
add("j07_combinations", lambda spark, sf: shown(selection.diverse_groups(pool(spark, sf), 3, 5)),
    "SELECT a.trajectory_id || '+' || b.trajectory_id || '+' || c.trajectory_id AS ids, " + rs("sc") + " AS score FROM (SELECT a, b, c, "
    "2 * len(list_distinct([a.direction_id, b.direction_id, c.direction_id])) + len(list_distinct([a.phase, b.phase, c.phase])) + (coalesce(a.metric, 0) + coalesce(b.metric, 0) + coalesce(c.metric, 0)) / 3 AS sc "
    "FROM ranked a JOIN ranked b ON a.place < b.place AND b.place <= 15 JOIN ranked c ON b.place < c.place AND c.place <= 15) ORDER BY sc DESC, a.place, b.place, c.place LIMIT 5", RANKED)
RANKED_SET = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {MERIT}) AS place FROM pool WHERE metric IS NOT NULL)"
add("r06_best_pairs", lambda spark, sf: shown(selection.best_groups(pool(spark, sf), 2, 25)),
    f"SELECT {PAIR} AS ids, {rs('a.metric + b.metric')} AS score FROM ranked a JOIN ranked b ON a.place < b.place ORDER BY a.metric + b.metric DESC, a.place, b.place LIMIT 25", RANKED_SET)
add("r07_top_successful",
    lambda spark, sf: selection.top_n(selection.successful(pool(spark, sf)), 12).select(*COLS, r("metric").alias("metric")),
    f"SELECT {C}, {rs('metric')} AS metric FROM pool WHERE metric > 0 ORDER BY {MERIT} LIMIT 12")

UNI = "(CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 12)) AS BIGINT) + 1) / 281474976710656.0"
U7 = UNI.format(seed=7, key="trajectory_id")


def weighted_sql(inverse: bool) -> str:
    scaled = "(coalesce(metric, 0) - lo) / (hi - lo)"
    weight = f"(1 - {scaled} + 0.1)" if inverse else f"({scaled} + 0.1)"
    return (f"(SELECT trajectory_id, '{'inverse' if inverse else 'plain'}' AS form FROM pool, (SELECT min(coalesce(metric, 0)) AS lo, "
            f"max(coalesce(metric, 0)) AS hi FROM pool) ORDER BY -ln({U7}) / {weight}, seq LIMIT 15)")


def r08(spark, sf):
    tag = lambda inv, t: selection.weighted_sample(pool(spark, sf), 15, 7, inv).select("trajectory_id", F.lit(t).alias("form"))
    return tag(False, "plain").unionByName(tag(True, "inverse"))


add("r08_weighted_sample", r08, f"SELECT * FROM {weighted_sql(False)} UNION ALL SELECT * FROM {weighted_sql(True)}")


def r09(spark, sf):
    n = 700
    p = pool(spark, sf)
    tag = lambda share, t: selection.top_share_and_random(p, share, n, 7).select("trajectory_id", F.lit(t).alias("form"))
    return tag(0.3, "filled").unionByName(tag(0.6, "share"))


def share_sql(share: float, tag: str) -> str:
    return (
        f"SELECT trajectory_id, '{tag}' AS form FROM (SELECT *, greatest(1, floor(count(*) OVER () * {share})) AS spots FROM ranked) "
        "WHERE place <= spots UNION ALL SELECT trajectory_id, '" + tag + "' FROM (SELECT *, row_number() OVER (ORDER BY "
        f"{U7}, seq) AS draw FROM (SELECT *, greatest(1, floor(count(*) OVER () * {share})) AS spots FROM ranked) WHERE place > spots) WHERE draw <= 700 - spots"
    )


add("r09_top_share_random", r09, share_sql(0.3, "filled") + " UNION ALL " + share_sql(0.6, "share"), RANKED)


def r05_strategies(spark, sf):
    p = pool(spark, sf)
    parts = [
        shown(selection.diverse_groups(p, 2, 5, strategy, seed=7)).withColumn("strategy", F.lit(strategy))
        for strategy in ("random", "weighted", "weighted_inverse")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def strategy_sql(strategy: str, order: str) -> str:
    chosen = f"SELECT *, row_number() OVER (ORDER BY {MERIT}) AS place FROM (SELECT pool.* FROM pool, (SELECT min(coalesce(metric, 0)) AS lo, max(coalesce(metric, 0)) AS hi FROM pool) ORDER BY {order}, seq LIMIT 10)"
    return f"SELECT * FROM (WITH c AS ({chosen}) SELECT {PAIR} AS ids, {rs(SCORE)} AS score, '{strategy}' AS strategy FROM c a JOIN c b ON a.place < b.place ORDER BY {SCORE} DESC, a.place, b.place LIMIT 5)"


SCALED = "(coalesce(metric, 0) - lo) / (hi - lo)"
add("r05_strategies", r05_strategies, " UNION ALL ".join([
    strategy_sql("random", U7),
    strategy_sql("weighted", f"-ln({U7}) / ({SCALED} + 0.1)"),
    strategy_sql("weighted_inverse", f"-ln({U7}) / (1 - {SCALED} + 0.1)"),
]))
add("r10_cross_direction_pairs",
    lambda spark, sf: selection.cross_direction_pairs(pool(spark, sf), 8, 7).select(F.array_join("ids", "+").alias("ids"), "crossed"),
    f"SELECT {PAIR} AS ids, true AS crossed FROM ranked a JOIN ranked b ON a.place < b.place AND a.direction_id <> b.direction_id ORDER BY a.place, b.place LIMIT 8", RANKED_SET)
LINEAGE = (
    "WITH RECURSIVE edges AS (SELECT 't' || c_custkey AS src, 't' || (c_custkey - 1) AS dst FROM customer WHERE c_custkey % 5 > 0 UNION ALL "
    "SELECT 't' || c_custkey, 't' || (c_custkey - 6) FROM customer WHERE c_custkey % 5 IN (2, 4) AND c_custkey >= 6), "
    "up AS (SELECT src AS seed, dst AS node, 1 AS d FROM edges UNION ALL SELECT seed, dst, d + 1 FROM up JOIN edges ON node = src WHERE d < 4) "
)


def r11(spark, sf):
    p = pool(spark, sf)
    up = graph.ancestry(selection.parent_edges(p), 4)
    return up.select(F.col("node").alias("trajectory"), "ancestor", "generations")


register("r11_lineage", r11, LINEAGE + "SELECT seed AS trajectory, node AS ancestor, CAST(min(d) AS INT) AS generations FROM up GROUP BY 1, 2")


def r12(spark, sf):
    p = pool(spark, sf)
    best = selection.best_so_far(p, "decision").select("trajectory_id", "round_idx", F.lit("best").alias("kind"))
    return best.unionByName(p.where("decision").select("trajectory_id", "round_idx", F.lit("accepted").alias("kind")))


add("r12_best_so_far", r12,
    "SELECT trajectory_id, round_idx, 'accepted' AS kind FROM pool WHERE decision UNION ALL "
    "(SELECT trajectory_id, round_idx, 'best' FROM pool WHERE decision ORDER BY round_idx DESC, seq DESC LIMIT 1)")
add("r13_bernoulli", lambda spark, sf: selection.bernoulli(pool(spark, sf), 0.3, 7, "trajectory_id").select("trajectory_id"),
    f"SELECT trajectory_id FROM pool WHERE {U7} <= 0.3")
add("a13_pool_statistics", lambda spark, sf: selection.pool_statistics(pool(spark, sf)),
    "SELECT phase, direction_id, CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(direction_id) = 0 THEN 'direction' ELSE 'all' END AS level, "
    "count(*) AS trajectories, count(*) FILTER (WHERE metric > 0) AS successful, max(round_idx) AS latest_round FROM pool GROUP BY GROUPING SETS ((phase), (direction_id), ())")
