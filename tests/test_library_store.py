"""Writing a library back: only touched parts, and none when the write fails."""

import pathlib

import pytest
from pyspark.sql import functions as F

from crosstide.operators import expressions
from crosstide.sources import libraries


def rows(spark, items):
    return spark.createDataFrame(items, "id string, text string, version long")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("part-*")}


def content(spark, path):
    return sorted(map(tuple, libraries.read_store(spark, path).select("id", "text", "version").collect()))


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "lib")
    first = [(f"f{i}", "old", 1) for i in range(60)] + [("f3", "older", 0)]
    assert len(libraries.upsert_store(rows(spark, first), path, "id", "version", 16)) > 8
    before = files(path)
    touched = libraries.upsert_store(rows(spark, [("f3", "new", 2), ("f4", "late", 0), ("g", "more", 1)]), path, "id", "version", 16)
    want = {f"f{i}": ("old", 1) for i in range(60)} | {"f3": ("new", 2), "g": ("more", 1)}
    assert content(spark, path) == sorted((k, *v) for k, v in want.items())
    after = files(path)
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert len(kept) >= 1 and all(after[f] == before[f] for f in kept)
    assert not (before.keys() - kept) & after.keys()
    assert libraries.upsert_store(rows(spark, []), path, "id", "version", 16) == [] and files(path) == after


def test_a_failed_write_leaves_the_old_library(spark, tmp_path):
    path = str(tmp_path / "lib")
    libraries.upsert_store(rows(spark, [(f"f{i}", "old", 1) for i in range(20)]), path, "id", "version", 4)
    before = files(path)

    @F.udf("string")
    def broken(text):
        raise RuntimeError("disk full")

    good = libraries.upsert

    def failing(old, new, key, order):
        return good(old, new, key, order).withColumn("text", broken("text"))

    libraries.upsert = failing
    try:
        with pytest.raises(Exception, match="disk full"):
            libraries.upsert_store(rows(spark, [(f"f{i}", "new", 2) for i in range(20)]), path, "id", "version", 4)
    finally:
        libraries.upsert = good
    assert files(path) == before and {t for _, t, _ in content(spark, path)} == {"old"}


def test_signs_keep_their_own_subtrees(spark):
    df = spark.createDataFrame([(1, "+$x"), (2, "not $x"), (3, "~$x"), (4, "-$x"), (5, "$x ** 2 || $y % .5"), (6, "($x"), (7, None)], "k int, e string")
    found = {}
    for r in expressions.explode_subtrees(df, "k", "e").collect():
        found.setdefault(r.k, set()).add((r.subtree, r.kind, r.size))
    assert found[1] == {("$x", "var", 1), ("(+$x)", "op", 2)} and found[2] == {("$x", "var", 1), ("(!$x)", "not", 2)}
    assert found[3] == {("$x", "var", 1), ("(~$x)", "op", 2)} and found[4] == {("$x", "var", 1), ("(-$x)", "op", 2)}
    counts = {r.k: (r.constants, r.variables, r.nodes) for r in expressions.node_counts(expressions.explode_subtrees(df, "k", "e"), "k").collect()}
    assert counts == {1: (0, 1, 2), 2: (0, 1, 2), 3: (0, 1, 2), 4: (0, 1, 2), 5: (2, 2, 7)}
