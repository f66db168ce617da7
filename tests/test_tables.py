"""Expressions, selection, graphs and vectors against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.operators import expressions, graph, lookups, metrics, ranking, selection, vectors
from crosstide.sources import libraries, stores
from crosstide.functions import rolling as ts

# -- expressions -----------------------------------------------------------------


def names(text):
    return {n: s for n, _, s in expressions.subtrees(text)}


def test_subtrees_of_every_construct():
    assert names("$a + 2*$b") == {"$a": 1, "2.0": 1, "$b": 1, "($b*2.0)": 3, "($a+($b*2.0))": 5} or names(
        "$a + 2*$b"
    ) == {"$a": 1, "2.0": 1, "$b": 1, "($b*2.0)": 3, "(($b*2.0)+$a)": 5}
    assert expressions.subtrees("$b+$a")[-1] == expressions.subtrees("$a + $b")[-1]
    assert expressions.subtrees("$b-$a")[-1][0] != expressions.subtrees("$a-$b")[-1][0]
    assert expressions.subtrees("F($x, 5)")[-1] == ("F($x,5.0)", "call", 3)
    assert expressions.subtrees("-$x")[-1] == ("(-$x)", "op", 2)
    assert expressions.subtrees("($a > 1 && $b < 2) ? $c : ($d ? 1 : 2)")[-1][2] == 13
    assert expressions.subtrees("F(($a ? 1 : 2), $b)")[-1][2] == 6
    assert expressions.subtrees("$a ? $b ? 1 : 2 : 3")[-1][2] == 7
    assert expressions.subtrees("F($a") == [] and expressions.subtrees("") == []


def test_largest_shared_matches_pairwise_comparison(spark):
    texts = [
        "RANK($a + $b) * 2", "RANK($b + $a) - 1", "$a", "F(RANK($a + $b) * 2)", "2 * RANK($b + $a)", "$zzz", "G($a, 3)",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, e string")
    trees = expressions.explode_subtrees(df, "k", "e")
    got = {r.k: (r.shared_size, r.zoo_key) for r in expressions.largest_shared(trees, trees, "k").collect()}
    for i, text in enumerate(texts):
        best = 0
        for j, other in enumerate(texts):
            if i != j:
                best = max([best, *[s for n, s in names(text).items() if n in names(other)]])
        assert got.get(i, (0, None))[0] == best
    assert 5 not in got


def test_acceptance_reasons(spark):
    df = spark.createDataFrame(
        [(1, 3, 1, 1, 10, 20, 1), (2, 9, 6, 1, 10, 20, 1), (3, None, 0, 1, 1, 400, 7)],
        "k int, shared_size int, constants int, variables int, nodes int, length int, features int",
    )
    got = {r.k: r.reasons for r in expressions.with_acceptance(df).collect()}
    assert got == {1: [], 2: ["shared", "constants"], 3: ["variables", "length", "features"]}


# -- lookups ----------------------------------------------------------------------

@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_equals_broadcast(spark, how):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"))
    right = spark.range(0, 5, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    rows = lambda most: sorted(map(str, lookups.lookup(left, right, ["k"], ["id"], how, most).collect()))
    assert rows(10) == rows(0)


# -- selection ----------------------------------------------------------------------

def make_pool(spark, seed, n, directions, missing=0.1):
    rng = random.Random(seed)
    rows = [
        (f"t{i}", i, rng.choice(directions), rng.randrange(4), rng.choice(["original", "mutation", "crossover"]),
         None if rng.random() < missing else round(rng.random(), 2))
        for i in range(n)
    ]
    schema = "trajectory_id string, seq long, direction_id int, round_idx int, phase string, metric double"
    return rows, spark.createDataFrame(rows, schema)


def ranked(rows):
    return sorted((r for r in rows if r[5] is not None), key=lambda r: (-r[5], r[1]))


@pytest.mark.parametrize("seed,directions", [(1, [0, 0, 0, 0, 0, 0, 1]), (2, [0, 1, 2, 3]), (3, [5]), (4, list(range(30)))])
def test_bounded_candidates_miss_nothing(spark, seed, directions):
    rows, pool = make_pool(spark, seed, 60, directions)
    order = ranked(rows)
    n = 6
    sums = sorted(itertools.combinations(range(len(order)), 2), key=lambda c: (-(order[c[0]][5] + order[c[1]][5]), c))
    want = [[order[i][0] for i in c] for c in sums[:n]]
    got = [r.ids for r in selection.best_groups(pool, 2, n).orderBy(F.col("score").desc(), "places").collect()]
    assert [sum(dict((r[0], r[5]) for r in rows)[i] for i in g) for g in got] == pytest.approx(
        [sum(dict((r[0], r[5]) for r in rows)[i] for i in g) for g in want]
    )
    crossed = [
        [order[i][0], order[j][0]] for i, j in itertools.combinations(range(len(order)), 2) if order[i][2] != order[j][2]
    ][:n]
    pairs = selection.cross_direction_pairs(pool, n).collect()
    assert sorted(map(tuple, [p.ids for p in pairs if p.crossed])) == sorted(map(tuple, crossed))
    assert len(pairs) == n


def test_scarce_cross_direction_partners(spark):
    """One outsider deep in the ranking of a one-direction pool."""
    rows = [(f"t{i}", i, 9 if i == 4 else 0, 0, "original", 1.0 - i / 100) for i in range(40)]
    pool = spark.createDataFrame(rows, "trajectory_id string, seq long, direction_id int, round_idx int, phase string, metric double")
    got = {tuple(p.ids) for p in selection.cross_direction_pairs(pool, 6).collect() if p.crossed}
    assert got == {("t0", "t4"), ("t1", "t4"), ("t2", "t4"), ("t3", "t4"), ("t4", "t5"), ("t4", "t6")}


@pytest.mark.parametrize("directions", [[0, 0, 0, 0, 0, 0, 1], [0, 1, 2, 3]])
def test_cross_direction_triples(spark, directions):
    rows, pool = make_pool(spark, 11, 24, directions)
    order, n = ranked(rows), 7
    crossed = [c for c in itertools.combinations(range(len(order)), 3) if len({order[i][2] for i in c}) > 1][:n]
    got = selection.cross_direction_groups(pool, 3, n).collect()
    assert {tuple(g.ids) for g in got if g.crossed} == {tuple(order[i][0] for i in c) for c in crossed}
    assert len(got) == n


@pytest.mark.parametrize("strategy", selection.STRATEGIES)
def test_groups_come_from_the_selected_trajectories(spark, strategy):
    rows, pool = make_pool(spark, 12, 40, [0, 1, 2])
    chosen = [r.trajectory_id for r in selection.preselected(pool, strategy, 8, 0.3, 5).collect()]
    assert len(chosen) == (12 if strategy == "top_percent_plus_random" else 8)
    table = {r[0]: r for r in rows}

    def score(ids):
        own = [table[i] for i in ids]
        return 2 * len({r[2] for r in own}) + len({r[4] for r in own}) + sum(r[5] or 0 for r in own) / len(own)

    best = sorted((score(c) for c in itertools.combinations(chosen, 2)), reverse=True)[:4]
    got = selection.diverse_groups(pool, 2, 4, strategy, 0.3, 5).collect()
    assert [g.score for g in got] == pytest.approx(best)
    assert all(g.score == pytest.approx(score(g.ids)) and set(g.ids) <= set(chosen) for g in got)
    loose = selection.diverse_groups(pool, 2, 4, strategy, 0.3, 5, prefer_diverse=False).collect()
    assert len({tuple(sorted(g.ids)) for g in loose}) == 4 and all(set(g.ids) <= set(chosen) for g in loose)


@pytest.mark.parametrize("hot", [10**9, 10])
def test_top_share_with_ties(spark, hot):
    rows, pool = make_pool(spark, 5, 90, [0, 1])
    pool = pool.withColumn("metric", F.when(F.col("seq") % 3 == 0, 0.5).otherwise(F.col("metric")))
    pdf = pool.toPandas().fillna({"metric": 0.0}).sort_values(["metric", "seq"], ascending=[False, True])
    want = set(pdf["trajectory_id"].head(27))
    got = selection.top_share_and_random(pool, 0.3, 40, 1, hot).toPandas()["trajectory_id"]
    assert len(got) == 40 and got.is_unique and want <= set(got)


def test_weighted_sample_prefers_heavy_rows(spark):
    _, pool = make_pool(spark, 6, 40, [0], 0)
    pool = pool.withColumn("metric", F.when(F.col("seq") < 4, 1.0).otherwise(0.0)).cache()
    hits = [
        sum(r.seq < 4 for r in selection.weighted_sample(pool, 4, seed, inverse).collect())
        for inverse in (False, True) for seed in range(6)
    ]
    assert sum(hits[:6]) > sum(hits[6:])


# -- graphs and traces ------------------------------------------------------------

def test_walk_with_split_hubs_equals_plain_walk(spark, monkeypatch):
    rng = random.Random(0)
    links = [("hub", f"n{i}") for i in range(40)] + [(f"n{rng.randrange(40)}", f"m{i}") for i in range(30)]
    edges = graph.both_ways(spark.createDataFrame(links, "src string, dst string"))
    seeds = spark.createDataFrame([("n1",), ("m3",), ("hub",)], "node string")
    rows = lambda **o: sorted(map(tuple, graph.within_steps(edges, seeds, 3, **o).collect()))
    plain = rows()
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert rows(hub_edges=7) == plain
    nbrs = {}
    for a, c in links:
        nbrs.setdefault(a, set()).add(c)
        nbrs.setdefault(c, set()).add(a)
    want = []
    for s in ("n1", "m3", "hub"):
        dist, layer = {s: 0}, [s]
        for d in range(1, 4):
            layer = sorted({m for x in layer for m in nbrs[x]} - dist.keys())
            dist.update(dict.fromkeys(layer, d))
        want += [(s, m, d) for m, d in dist.items() if d]
    assert plain == sorted(want)


def test_trace_cleanup_matches_the_step_by_step_rule(spark):
    # a failure stays only where its task has had no success before; successes all stay
    cases = {"---": "012", "+--": "0", "-+-+-": "013", "++": "01", "--+": "012", "-+--+": "014"}
    rows = [(case, i, mark == "+") for case in cases for i, mark in enumerate(case)]
    df = spark.createDataFrame(rows, "task string, attempt int, success boolean")
    got = {}
    for r in graph.clean_traces(df).collect():
        got.setdefault(r.task, []).append(r.attempt)
    assert {task: "".join(map(str, sorted(kept))) for task, kept in got.items()} == cases


# -- vectors ------------------------------------------------------------------------

def test_similarity_paths_agree_and_copies_do_not_flood(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    base[20:45] = base[3]  # a large group of exact copies
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base)], "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(7)], "query_id long, embedding array<double>")
    rows = lambda: sorted((r.query_id, r.place, r.id) for r in vectors.top_similar(v, q, 5).collect())
    first = rows()
    assert vectors._similarities(v, q, 5, 0.0).count() <= 7 * 5 * 3
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 25)
    assert rows() == first
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for i in range(7):
        score = np.round(unit @ unit[i], 12)
        order = sorted((-s, j) for j, s in enumerate(score) if s > 0)[:5]
        assert [x[2] for x in first if x[0] == i] == [j for _, j in order]


def test_chunks_and_parts_keep_whole_texts(spark):
    docs = spark.createDataFrame([(1, "é" * 2500), (2, "abc"), (3, "")], "k int, t string")
    got = {}
    for r in vectors.chunks(docs, "k", "t", 1000).orderBy("k", "chunk").collect():
        got[r.k] = got.get(r.k, "") + r.text
    assert got == {1: "é" * 2500, 2: "abc"}
    pages = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("p"), F.col("id").cast("string").alias("t"))
    parts = vectors.concatenate(pages, "k", "p", "t", per_part=10).orderBy("part").collect()
    assert "\n".join(p.text for p in parts) == "\n".join(map(str, range(25))) and len(parts) == 3
    whole = vectors.concatenate(pages, "k", "p", "t").collect()
    assert [(p.part, p.text) for p in whole] == [(0, "\n".join(map(str, range(25))))]


# -- libraries and stores --------------------------------------------------------------

def test_library_file_round_trip(spark, tmp_path):
    doc = """{"metadata": {"version": "1"}, "factors": {
      "a": {"factor_expression": "RANK($close)", "backtest_results": {"IC": 0.5, "note": "none", "ICIR": "0.25", "Rank IC": null}},
      "b": {"factor_name": "B", "factor_expression": ""},
      "c": {"factor_name": "C", "factor_expression": "$open", "quality": "high"}}}"""
    (tmp_path / "lib.json").write_text(doc)
    rows = libraries.read_libraries(spark, str(tmp_path / "lib.json"))
    assert {r.factor_id: r.factor_name for r in rows.collect()} == {"a": "a", "c": "C"}
    assert rows.where("factor_id = 'a'").first().backtest_results == {"IC": 0.5, "note": None, "ICIR": 0.25, "Rank IC": None}
    (tmp_path / "broken.json").write_text(doc[:-3])
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        libraries.read_libraries(spark, str(tmp_path / "broken.json")).collect()


def test_quality_skips_missing_ratios(spark):
    df = spark.sql("SELECT map('a.information_ratio', CAST(NULL AS double), 'b.information_ratio', 0.9D) AS m")
    assert df.select(libraries.quality_class("m").alias("q")).first().q == "high"


# -- inputs that once lost rows or changed answers ---------------------------------------

@pytest.mark.parametrize("kind,values", [
    ("bigint", [2**53, 2**53 + 1, 2**53 + 2, 2**53 + 3]),
    ("decimal(38,0)", [10**30, 10**30 + 1, 10**30 + 2, 10**30 + 3]),
    ("string", ["a", "b", "c", "d"]),
])
def test_rank_paths_agree_on_every_type(spark, kind, values):
    rows = [(1, i, None if v is None else str(v)) for i, v in enumerate([*values, values[1], None])]
    df = spark.createDataFrame(rows, "datetime int, instrument int, v string").withColumn("v", F.col("v").cast(kind))
    for hot in (1_000, 2):
        got = ranking.with_ranks(df, {"rank": "v"}, hot_rows=hot, pct=False).orderBy("instrument").collect()
        assert [r["rank"] for r in got] == [1.0, 2.5, 4.0, 5.0, 2.5, None]


def test_rank_with_one_value_on_most_of_a_date(spark):
    df = spark.range(500).selectExpr("1 AS datetime", "id AS instrument", "CASE WHEN id < 450 THEN 0.0D ELSE CAST(id AS double) END AS v")
    rows = ranking.with_ranks(df, {"rank": "v"}, hot_rows=50).orderBy("instrument").collect()
    assert rows[0]["rank"] == rows[449]["rank"] == 451 / 2 / 500 and rows[499]["rank"] == 1.0


def test_balanced_top_keeps_the_limit_with_unknown_classes(spark):
    df = spark.createDataFrame([(1, i, [True, False, None][i % 3]) for i in range(30)], "q int, o int, v boolean")
    assert graph.balanced_top(df, "q", "o", "v", 6).count() == 6


def test_vectors_without_length_null_and_text_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "id string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert sorted(map(tuple, vectors.similarities(v, q).fillna(-9.0).collect())) == [("x", "a", 1.0), ("x", "b", -9.0), ("y", "a", 1.0), ("y", "b", -9.0)]
    assert {(r.id, r.query_id, r.similarity) for r in vectors.nearest_query(v, q).collect()} == {("a", "x", 1.0), ("b", "x", None)}
    assert vectors.top_similar(v, q, 1).count() == 2


def test_clusters_keep_their_limit_or_say_so(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 6)))], "id int, embedding array<double>")
    assert vectors.cluster(v, 15).groupBy("cluster").count().agg(F.max("count")).first()[0] < 15
    with pytest.raises(ValueError):
        vectors.cluster(v, 5, most_clusters=3)


def test_clusters_are_nearest_and_few(spark):
    rng = np.random.default_rng(5)
    spots = np.repeat(rng.normal(size=(6, 8)), [50, 20, 20, 10, 5, 3], axis=0)
    rows = [(i, x.tolist()) for i, x in enumerate(spots + rng.normal(size=spots.shape) / 50)]
    v = spark.createDataFrame([*rows, (500, [0.0] * 8), (501, None)], "id int, embedding array<double>")
    members, centres = vectors.clustering(v, 60)
    found = {r.id: r.cluster for r in members.collect()}
    middle = {r.cluster: np.array(r.centre) for r in centres.collect()}
    assert len(found) == 110 and found[500] is None and found[501] is None
    sizes = {}
    for i, x in rows:
        dots = {c: float(np.dot(x, m)) for c, m in middle.items()}
        assert dots[found[i]] >= max(dots.values()) - 1e-9
        sizes[found[i]] = sizes.get(found[i], 0) + 1
    assert max(sizes.values()) < 60 and 2 <= len(middle) <= 4
    assert vectors.cluster(v.limit(0), 5).count() == 0
    assert {r.cluster for r in vectors.cluster(v.where("id < 30"), 99).collect()} == {0}


def test_total_loss_has_a_drawdown(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.5), (3, 0.1)], "datetime int, excess double")
    assert metrics.risk_metrics(df, compound=True).first().max_drawdown in (None, -1.0, 0.0)


def test_unparsable_expressions_are_rejected_not_lost(spark):
    df = spark.createDataFrame([(1, "RANK($close)"), (2, "RANK($close")], "k int, e string")
    counts = expressions.node_counts(expressions.explode_subtrees(df, "k", "e"), "k").withColumn("parsed", F.lit(True))
    facts = df.join(counts, "k", "left").selectExpr("*", "0 AS shared_size", "10 AS length", "1 AS features")
    out = {r.k: list(r.reasons) for r in expressions.with_acceptance(facts, max_penalty=9.9).collect()}
    assert out == {1: [], 2: ["unparsable"]}


def test_store_computes_only_what_is_missing(spark, hand_panel, tmp_path):
    path = str(tmp_path / "store")
    assert sorted(stores.fill_store(hand_panel, {"a": ts.mean("x", 2), "b": F.col("y")}, path)) == ["a", "b"]
    assert stores.fill_store(hand_panel, {"b": F.col("y"), "c": ts.std("x", 3)}, path) == ["c"]
    assert stores.read_store(spark, path, ["c"]).count() == hand_panel.count()
    assert stores.read_store(spark, path, ["z"]).count() == 0


def test_store_keeps_the_panels_instruments(spark, hand_panel, tmp_path):
    path = str(tmp_path / "store")
    named = hand_panel.withColumn("instrument", F.concat(F.lit("SH"), F.col("instrument").cast("string")))
    stores.fill_store(named, {"b": F.col("y")}, path)
    got = {(r.datetime, r.instrument): r.value for r in stores.read_store(spark, path, ["b"]).collect()}
    assert got == {(r.datetime, r.instrument): r.y for r in named.collect()}


# -- correlation of many factors ---------------------------------------------------------

def test_correlation_of_many_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 40)) * np.logspace(-3, 3, 40) + np.logspace(-2, 4, 40)
    x[:, 7] = x[:, 3] * 2 + 1
    x[:, 9] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"f{i}" for i in range(40)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r.a, r.b): r["corr"] for r in metrics.correlation_pairs(df, names).collect()}
    assert len(got) == 780
    for (a, b), c in got.items():
        u, v = x[:, int(a[1:])], x[:, int(b[1:])]
        both = ~np.isnan(u) & ~np.isnan(v)
        if 9 in (int(a[1:]), int(b[1:])):
            assert c is None
        else:
            assert abs(c - np.corrcoef(u[both], v[both])[0, 1]) < 1e-9
    assert metrics.correlation_pairs(df.limit(0), names[:3]).where("corr IS NOT NULL").count() == 0


def test_clusters_of_many_vectors_need_no_fit_for_every_k(spark):
    # a crowd that one centre cannot keep, copies beside it, and as many copies as no clustering can part
    rng = np.random.default_rng(8)
    crowd = rng.normal(size=8) + rng.normal(size=(900, 8)) / 40
    rows = [*enumerate([*crowd.tolist(), *[rng.normal(size=8).tolist()] * 15, *rng.normal(size=(600, 8)).tolist()])]
    v = spark.createDataFrame(rows, "id int, embedding array<double>")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    members, centres = vectors.clustering(v, 20)
    middle, found = {r.cluster: np.array(r.centre) for r in centres.collect()}, {r.id: r.cluster for r in members.collect()}
    assert jobs() - before < 400 and len(found) == len(rows)
    assert max(np.bincount(list(found.values()))) < 20 and set(found.values()) == set(middle)
    whole = np.vstack([middle[c] for c in sorted(middle)])
    for i, x in rows:
        assert float(np.dot(x, middle[found[i]])) >= float((whole @ np.array(x)).max()) - 1e-9
    with pytest.raises(ValueError):
        vectors.cluster(v.where("id BETWEEN 890 AND 920"), 15)


def test_walk_is_stored_once_for_seeds_with_the_same_neighbours(spark, monkeypatch):
    # 200 seeds at one hub: the pairs of seeds belong to the result, not to what the hops write down
    links = [(f"s{i:03}", "hub") for i in range(200)] + [("hub", "top"), ("top", "s000"), ("s001", "s002"), ("alone", "alone")]
    edges = graph.both_ways(spark.createDataFrame(links, "src string, dst string"))
    seeds = spark.createDataFrame([(f"s{i:03}",) for i in range(200)] + [("alone",), ("nowhere",)], "node string")
    stored, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (lambda kept: (stored.append(kept.count()), kept)[1])(cut(df)))
    got = {(r.seed, r.node): r.distance for r in graph.within_steps(edges, seeds, 3).collect()}
    assert max(stored) < 5_000
    nbrs = {}
    for a, c in links:
        nbrs.setdefault(a, set()).add(c)
        nbrs.setdefault(c, set()).add(a)
    want = {}
    for s in (f"s{i:03}" for i in range(200)):
        seen, layer = {s}, {s}
        for d in range(1, 4):
            layer = {m for x in layer for m in nbrs[x]} - seen
            seen |= layer
            want.update({(s, m): d for m in layer})
    assert got == want
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookups, "is_small", lambda *a, **o: False)
    assert {(r.seed, r.node): r.distance for r in graph.within_steps(edges, seeds, 3).collect()} == want


def test_clusters_just_over_the_limit_are_parted_not_peeled(spark):
    # vectors in all directions beside a crowd: a drawn member takes few others along, so sizes fell by little a round
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = np.vstack([unit(rng.normal(size=(1500, 64))), unit(rng.normal(size=64)) + rng.normal(size=(300, 64)) / 80])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id int, embedding array<double>")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    members, centres = vectors.clustering(v, 60)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    middle, found = {r.cluster: np.array(r.centre) for r in centres.collect()}, {r.id: r.cluster for r in members.collect()}
    assert len(jobs) < 150 and len(found) == len(rows)
    assert max(np.bincount(list(found.values()))) < 60 and set(found.values()) == set(middle)
    whole = np.vstack([middle[c] for c in sorted(middle)])
    dots = rows @ whole.T
    at = np.searchsorted(sorted(middle), [found[i] for i in range(len(rows))])
    assert (dots[np.arange(len(rows)), at] >= dots.max(axis=1) - 1e-9).all()


def test_products_in_single_precision_decide_as_in_double():
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    spots = unit(rng.normal(size=(40, 16)))
    centres = unit(np.vstack([spots, spots + rng.normal(size=spots.shape) * 1e-8]))  # pairs that single precision cannot part
    x = unit(np.repeat(centres, 30, axis=0) + rng.normal(size=(2400, 16)) / 10)
    assert vectors._Centres(centres).places(x).tolist() == np.argmax(x @ centres.T, axis=1).tolist()
