"""Vectors, text, graphs, traces, clusters, model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.catalog.common import panel, r, register, rs, table, with_panel
from crosstide.catalog.panel_ops import FOUR, LABEL_SQL
from crosstide.functions import rolling as ts
from crosstide.functions.basics import div
from crosstide.operators import graph, modelling, pivots, vectors
from crosstide.operators.lookups import with_row
from crosstide.plans import dataset, feature_sets, trial
from crosstide.session import cut_lineage
from crosstide.sources import panel as panels


def vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def centres(spark, sf):
    """One query per label: its mean vector."""
    return vectors.mean_vectors(vecs(spark, sf), "label")


SIM_SQL = """
WITH dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM dims GROUP BY 1),
sims AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(c, CAST(embedding AS DOUBLE[])), 12) AS s FROM embeddings, q)
"""
register(
    "g01_cosine_topk",
    lambda spark, sf: vectors.top_similar(vecs(spark, sf), centres(spark, sf), 10, 0.1).select(
        "query_id", "id", F.col("place").cast("int").alias("place"), r("similarity").alias("similarity")
    ),
    SIM_SQL + f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS place, {rs('s')} AS similarity "
    "FROM sims WHERE s > 0.1 QUALIFY place <= 10",
)


def g01_pruned(spark, sf):
    """The same rows from a pivot index; how much it leaves unread depends on how the vectors cluster."""
    found = pivots.top_similar(pivots.build(vecs(spark, sf)), centres(spark, sf), 10, 0.1)
    return found.best.select("query_id", "id", F.col("place").cast("int").alias("place"), r("similarity").alias("similarity"))


register("g01_pruned_topk", g01_pruned,
    SIM_SQL + f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS place, {rs('s')} AS similarity "
    "FROM sims WHERE s > 0.1 QUALIFY place <= 10")
register(
    "g02_similarity_matrix",
    lambda spark, sf: vectors.similarities(vecs(spark, sf), centres(spark, sf)).select(
        "query_id", "id", r("similarity").alias("similarity")
    ),
    SIM_SQL + f"SELECT query_id, id, {rs('s')} AS similarity FROM sims",
)
register(
    "j09_nearest_centre",
    lambda spark, sf: vectors.nearest_query(vecs(spark, sf), centres(spark, sf)).select(
        "id", "query_id", r("similarity").alias("similarity")
    ),
    SIM_SQL + f"SELECT id, query_id, {rs('s')} AS similarity FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, query_id) = 1",
)
register(
    "g03_text_chunks",
    lambda spark, sf: vectors.chunks(table(spark, sf, "documents"), "doc_id", "text", 1000),
    "SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, i * 1000 + 1, 1000) AS text FROM "
    "(SELECT doc_id, text, unnest(range((length(text) + 999) // 1000)) AS i FROM documents)",
)

# -- graph: regions, nations, customers, suppliers by their keys -------------------

NODES_TEXT = [
    ("region", "'r' || CAST(r_regionkey AS STRING)", "r_name"),
    ("nation", "'n' || CAST(n_nationkey AS STRING)", "n_name"),
    ("customer", "'c' || CAST(c_custkey AS STRING)", "c_mktsegment"),
    ("supplier", "'s' || CAST(s_suppkey AS STRING)", "s_name"),
]
EDGES_TEXT = [
    ("nation", "'n' || CAST(n_nationkey AS STRING)", "'r' || CAST(n_regionkey AS STRING)"),
    ("customer", "'c' || CAST(c_custkey AS STRING)", "'n' || CAST(c_nationkey AS STRING)"),
    ("supplier", "'s' || CAST(s_suppkey AS STRING)", "'n' || CAST(s_nationkey AS STRING)"),
]


def nodes(spark, sf):
    out = None
    for name, key, content in NODES_TEXT:
        part = table(spark, sf, name).select(
            F.expr(key).alias("id"), F.lit(name).alias("label"), F.col(content).alias("content")
        )
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark, sf):
    out = None
    for name, a, c in EDGES_TEXT:
        part = table(spark, sf, name).select(F.expr(a).alias("src"), F.expr(c).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


GRAPH_SQL = (
    "nodes AS (" + " UNION ALL ".join(f"SELECT {k} AS id, '{n}' AS label, {c} AS content FROM {n}" for n, k, c in NODES_TEXT) + ")",
    "one AS (" + " UNION ALL ".join(f"SELECT {a} AS src, {c} AS dst FROM {n}" for n, a, c in EDGES_TEXT) + ")",
    "edges AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one)",
)


def walk_sql(seed: str, steps: int, final: str, allowed: str = "true") -> str:
    """Breadth-first walk as nested joins; distance is the first step reached."""
    parts = [f"h0 AS (SELECT id AS seed, id AS node, 0 AS d FROM nodes WHERE label = '{seed}')"]
    for i in range(1, steps + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM h{j}" for j in range(i))
        parts.append(
            f"h{i} AS (SELECT DISTINCT seed, dst AS node, {i} AS d FROM h{i - 1} JOIN edges ON node = src JOIN nodes ON id = dst "
            f"WHERE {allowed} AND (seed, dst) NOT IN ({seen}))"
        )
    found = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(1, steps + 1))
    return "WITH " + ",".join([*GRAPH_SQL, *parts, f"found AS ({found})"]) + " " + final


def seeds(spark, sf, label):
    return nodes(spark, sf).where(F.col("label") == label).select(F.col("id").alias("node"))


def walk(spark, sf, label, steps, **options):
    return graph.within_steps(
        graph.both_ways(edges(spark, sf)), seeds(spark, sf, label), steps, nodes(spark, sf), **options
    )


register(
    "g04_within_steps",
    lambda spark, sf: walk(spark, sf, "region", 2),
    walk_sql("region", 2, "SELECT seed, node, CAST(d AS INT) AS distance FROM found"),
)
register(
    "g04_within_steps_labels",
    lambda spark, sf: walk(spark, sf, "supplier", 3, labels=["region", "supplier"]),
    walk_sql("supplier", 3, "SELECT seed, node, CAST(d AS INT) AS distance FROM found JOIN nodes ON id = node WHERE label IN ('region', 'supplier')"),
)
register(
    "g04_within_steps_block",
    lambda spark, sf: walk(spark, sf, "supplier", 3, labels=["nation", "region"], block=True),
    walk_sql("supplier", 3, "SELECT seed, node, CAST(d AS INT) AS distance FROM found", "label IN ('nation', 'region')"),
)


REGION = 2


def g05(spark, sf):
    """From the nations of one region: nodes that several of them reach, and whether all do."""
    inside = table(spark, sf, "nation").where(F.col("n_regionkey") == REGION)
    start = inside.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    reached = cut_lineage(graph.within_steps(graph.both_ways(edges(spark, sf)), start, 3))
    every = graph.common_to_all(reached, start.count()).withColumn("all", F.lit(True))
    return graph.shared_neighbours(reached).join(every, "node", "left").select("node", "seeds", F.coalesce("all", F.lit(False)).alias("all"))


register("g05_neighbourhood_intersection", g05, walk_sql(
    "nation", 3, f"SELECT node, count(*) AS seeds, count(*) = (SELECT count(*) FROM nation WHERE n_regionkey = {REGION}) AS \"all\" FROM found "
    f"WHERE seed IN (SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = {REGION}) GROUP BY 1 HAVING count(*) >= 2"))


def vector_graph(spark, sf):
    """Vectors linked through their labels."""
    v = vecs(spark, sf)
    links = v.select(F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("l"), "label").alias("dst"))
    return v, graph.both_ways(links)


def g06(spark, sf):
    v, links = vector_graph(spark, sf)
    hits = vectors.top_similar(v, centres(spark, sf), 3, 0.0).select(
        "query_id", "place", F.concat(F.lit("v"), "id").alias("seed")
    )
    near = graph.within_steps(links, hits.select(F.col("seed").alias("node")), 2)
    reach = hits.join(near, "seed").groupBy("query_id", "node").agg(
        F.min(F.struct("place", "distance")).alias("_k")
    )
    ranked = Window.partitionBy("query_id").orderBy("_k", "node")
    top = reach.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= 8)
    return top.select("query_id", "node", F.col("place").cast("int").alias("place"))


register("g06_search_then_expand", g06, SIM_SQL + """,
hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM sims WHERE s > 0 QUALIFY place <= 3),
near AS (
  SELECT query_id, place, 1 AS d, 'l' || e.label AS node FROM hits JOIN embeddings e ON e.vec_id = id
  UNION ALL
  SELECT query_id, place, 2, 'v' || f.vec_id FROM hits JOIN embeddings e ON e.vec_id = id JOIN embeddings f ON f.label = e.label AND f.vec_id <> e.vec_id)
SELECT query_id, node, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, node) AS INT) AS place
FROM (SELECT query_id, node, min((place, d)) AS k FROM near GROUP BY 1, 2) QUALIFY place <= 8""")


def g07(spark, sf):
    v, links = vector_graph(spark, sf)
    constraint = centres(spark, sf).where("query_id = 0")
    gaps = vectors.similarities(v, constraint).select(
        F.concat(F.lit("v"), "id").alias("node"), (1 - F.col("similarity")).alias("distance_to_constraint")
    )
    start = v.select(F.concat(F.lit("l"), "label").alias("node"))
    reached = graph.within_steps(links, start, 1)
    far = graph.passes_distance(reached, gaps, 1.25).select("seed", "node", F.lit("far").alias("test"))
    near = graph.passes_distance(reached, gaps, 0.4, near=True).select("seed", "node", F.lit("near").alias("test"))
    return far.unionByName(near)


register("g07_distance_test", g07, SIM_SQL + """,
gaps AS (SELECT id, 1 - s AS gap FROM sims WHERE query_id = 0),
seeds AS (SELECT label, max(gap) > 1.25 AS far, min(gap) <= 0.4 AS near FROM embeddings JOIN gaps ON vec_id = id GROUP BY 1)
SELECT 'l' || label AS seed, 'v' || vec_id AS node, 'far' AS test FROM embeddings JOIN seeds USING (label) WHERE far
UNION ALL SELECT 'l' || label, 'v' || vec_id, 'near' FROM embeddings JOIN seeds USING (label) WHERE near""")


def g08(spark, sf):
    doubled = graph.both_ways(edges(spark, sf)).unionByName(edges(spark, sf))
    pairs = graph.undirected(doubled).select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    kept = graph.merge_nodes(nodes(spark, sf)).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("content").alias("b"))
    return pairs.unionByName(kept)


register("g08_dedup_edges_nodes", g08, "WITH " + ",".join(GRAPH_SQL) + " SELECT DISTINCT 'edge' AS kind, least(src, dst) AS a, greatest(src, dst) AS b FROM edges "
         "UNION ALL SELECT 'node', min(id), content FROM nodes GROUP BY content, label")


def g09(spark, sf):
    a = table(spark, sf, "customer").select(F.expr("c_nationkey * 100 + c_custkey % 7").alias("c_nationkey"))
    c = table(spark, sf, "supplier").select(F.expr("s_nationkey * 100 + s_suppkey % 5").alias("c_nationkey"))
    return graph.intersection(a, c).withColumn("op", F.lit("both")).unionByName(
        graph.symmetric_difference(a, c).withColumn("op", F.lit("either"))
    )


register("g09_set_operations", g09, """
WITH a AS (SELECT DISTINCT c_nationkey * 100 + c_custkey % 7 AS c_nationkey FROM customer), b AS (SELECT DISTINCT s_nationkey * 100 + s_suppkey % 5 AS c_nationkey FROM supplier)
SELECT c_nationkey, 'both' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT c_nationkey, 'either' FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def g10(spark, sf):
    """What holds for any clustering, shown per vector and worked out from the centres, not by the model:
    its cluster's centre is no farther than any other, and the cluster is below the limit."""
    base = vecs(spark, sf)
    found = vectors.clustering(base, 120)
    sizes = found.members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    rows = found.centres.orderBy("cluster").collect()  # as many as clusters
    names, middle = np.array([c["cluster"] for c in rows]), np.array([c["centre"] for c in rows])

    @F.pandas_udf("boolean")
    def nearest(embedding: pd.Series, cluster: pd.Series) -> pd.Series:
        out, step = [], vectors.product_rows(len(middle))
        for at in range(0, len(embedding), step):
            x, c = embedding.iloc[at : at + step], cluster.iloc[at : at + step]
            dots = np.vstack(x.to_list()).astype(float) @ middle.T
            out.append(dots[np.arange(len(x)), np.searchsorted(names, c)] >= dots.max(axis=1) - 1e-9)
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    close = base.join(found.members.where(F.col("cluster").isNotNull()), "id").join(F.broadcast(sizes), "cluster")
    return close.select("id", nearest("embedding", "cluster").alias("nearest"), (F.col("members") < 120).alias("below_limit"))


register("g10_spherical_kmeans", g10, "SELECT vec_id AS id, true AS nearest, true AS below_limit FROM embeddings")

# -- traces: a customer's orders in sequence are attempts at one task ---------------

def attempts(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("attempt"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)).alias("success"),
    )


TRACE_SQL = "t AS (SELECT o_custkey AS task, o_orderkey AS attempt, o_orderstatus = 'F' AND o_totalprice > 250000 AS success FROM orders)"
register(
    "g11_trace_cleanup",
    lambda spark, sf: graph.clean_traces(attempts(spark, sf), 5),
    f"WITH {TRACE_SQL} SELECT task, attempt, success FROM (SELECT *, bool_or(success) OVER (PARTITION BY task ORDER BY attempt) AS solved FROM t) "
    "WHERE success OR NOT solved QUALIFY row_number() OVER (PARTITION BY task ORDER BY attempt DESC) <= 5",
)
register(
    "g12_repeated_failures",
    lambda spark, sf: graph.repeated_failures(attempts(spark, sf), 12),
    f"WITH {TRACE_SQL} SELECT task, count(*) AS attempts FROM t GROUP BY 1 HAVING count(*) >= 12 AND NOT bool_or(success)",
)
register(
    "g13_balanced_top",
    lambda spark, sf: graph.balanced_top(attempts(spark, sf), "task", "attempt", "success", 6).select("task", "attempt", "success"),
    f"WITH {TRACE_SQL} SELECT task, attempt, success FROM (SELECT *, row_number() OVER (PARTITION BY task, success ORDER BY attempt) AS n, "
    "greatest(least(4, count(*) FILTER (WHERE success) OVER (PARTITION BY task)), 6 - count(*) FILTER (WHERE NOT success) OVER (PARTITION BY task)) AS q FROM t) "
    "WHERE n <= CASE WHEN success THEN q ELSE 6 - q END",
)

# -- sorts and text ------------------------------------------------------------------

DIFFICULTY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "1-URGENT"]


def o01(spark, sf):
    """Custom order Easy < Medium < Hard < New Discovery, made visible as a number."""
    name = F.try_element_at(F.array(*map(F.lit, ["Easy", "Medium", "Hard", "New Discovery"])), F.col("place"))
    place = F.lit(len(DIFFICULTY) + 1)  # values without a class sort last
    for i, value in enumerate(DIFFICULTY):
        place = F.when(F.col("o_orderpriority") == value, i + 1).otherwise(place)
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", place).select("place", name.alias("difficulty"), "n").orderBy("place")


register("o01_custom_order", o01, """
SELECT place, ['Easy', 'Medium', 'Hard', 'New Discovery'][place] AS difficulty, count(*) AS n FROM (
  SELECT CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 5 END AS place FROM orders)
GROUP BY 1 ORDER BY 1""")
register(
    "o04_concatenate_pages",
    lambda spark, sf: vectors.concatenate(table(spark, sf, "conversations"), "conv_id", "turn", "text"),
    "SELECT conv_id, 0 AS part, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
)

# -- model -----------------------------------------------------------------------------

SEGMENTS = {
    "train": ("1995-01-01", "1998-12-31"),
    "valid": ("1999-01-01", "1999-12-31"),
    "test": ("2000-01-01", "2001-12-31"),
}


#: The next row's return, which a panel of drawn prices lets one foresee; the return after it is chance.
NEXT_SQL = "lead(close) OVER (PARTITION BY instrument ORDER BY datetime) / nullif(close, 0) - 1"


def fitted(spark, sf):
    bars = panel(spark, sf).withColumn("label", div(ts.ahead("close", 1), F.col("close")) - 1)
    matrix = feature_sets.factor_matrix(bars, feature_sets.baseline_4(), ["label"])
    ready = cut_lineage(panels.with_segment(dataset.prepare(cut_lineage(matrix), FOUR, "label"), SEGMENTS))
    return ready, modelling.fit_signal(ready, FOUR, "label")


def l02(spark, sf):
    """Every test row has a score, and over all of them the squared error is below that of the mean label."""
    ready, model = fitted(spark, sf)
    scored = model.score(ready.where("segment = 'test'")).withColumn("scored", F.col("score").isNotNull() & ~F.isnan("score"))
    mean = ready.where("segment = 'train'").agg(F.avg("label").alias("mean"))
    errors = with_row(scored, mean).agg(
        (F.sum(F.pow(F.col("score") - F.col("label"), 2)) < F.sum(F.pow(F.col("mean") - F.col("label"), 2))).alias("better")
    )
    return with_row(scored, errors).select("datetime", "instrument", "scored", F.col("better").alias("beats_mean"))


def l02_scores(spark, sf):
    """The scores themselves; what trees give, SQL cannot, so there is no twin."""
    ready, model = fitted(spark, sf)
    return model.score(ready.where("segment = 'test'")).select("datetime", "instrument", "label", "score")


register("l02_boosted_signal", l02, with_panel(
    "SELECT datetime, instrument, true AS scored, true AS beats_mean FROM (SELECT datetime, instrument, " + NEXT_SQL + " AS label FROM panel) "
    f"WHERE label IS NOT NULL AND datetime BETWEEN DATE '{SEGMENTS['test'][0]}' AND DATE '{SEGMENTS['test'][1]}'"))
register("l02_boosted_scores", l02_scores)


def backtest_days(spark, sf):
    """The 20-factor set through fit, coefficients, portfolio and cost, a row per test date.

    What no tree decides is shown as it is, what the trees decide as the bounds it must keep.
    """
    days = trial.daily(trial.signal(panel(spark, sf), feature_sets.set_158_20(), SEGMENTS), scale=0.01)
    within = lambda c: F.coalesce(F.abs(c) <= 1 + 1e-9, F.lit(True))
    parts = F.col("port_ret") - F.col("bench") - F.col("cost")
    return days.select(
        "datetime", "rows", "held", r("bench").alias("bench"), (within("ic") & within("rank_ic")).alias("bounded"),
        F.col("cost").between(0, 0.002).alias("cheap"), (F.abs(F.col("excess") - parts) < 1e-9).alias("adds_up"),
    )


BACKTEST_DAYS_SQL = with_panel(
    f"SELECT datetime, count(*) AS rows, least(count(*), 50) AS held, {rs('avg(label) / 100')} AS bench, true AS bounded, true AS cheap, true AS adds_up "
    "FROM (SELECT datetime, instrument, " + LABEL_SQL + " AS label FROM panel) "
    f"WHERE label IS NOT NULL AND datetime BETWEEN DATE '{SEGMENTS['test'][0]}' AND DATE '{SEGMENTS['test'][1]}' GROUP BY 1"
)
register("b01_backtest", backtest_days, BACKTEST_DAYS_SQL)
