"""Lineage by path doubling."""

from crosstide.operators import graph


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(30, 10), (None, 3), (4, None), (5, 5)], "src int, dst int")
    got = {(r.node, r.ancestor): r.generations for r in graph.ancestry(edges).collect()}
    assert len(rounds) <= 8 and len(got) == 61 * 60 // 2
    assert got[60, 0] == 60 - 20 + 1 and got[30, 10] == 1 and got[9, 2] == 7


def test_cycles_end_and_generations_are_bounded(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (2, 3)], "src int, dst int")
    got = {(r.node, r.ancestor): r.generations for r in graph.ancestry(edges).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 2): 1, (1, 0): 2, (1, 3): 2, (2, 0): 1, (2, 1): 2, (2, 3): 1}
    assert {(r.node, r.ancestor) for r in graph.ancestry(edges, 1).collect()} == {(0, 1), (1, 2), (2, 0), (2, 3)}
    assert max(r.generations for r in graph.ancestry(edges, 2).collect()) == 2
    assert graph.ancestry(edges.limit(0)).count() == 0
