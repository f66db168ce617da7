"""Quality ranking: held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.llm import catalog, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = catalog.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    rest = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    assert len(rest) > 50 and np.mean([r["predicted"] == r["quality"] for r in rest]) >= 0.97
    good, bad = [r["score"] for r in rest if r["quality"]], [r["score"] for r in rest if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) >= 0.98


def test_odd_inputs(spark):
    rows = [(1, "fine words, said plainly."), (2, None), (3, ""), (4, " \n"), (None, "no key"), (1, "fine words, said plainly."), (5, "ǰ ŉ ﬁ İ" * 9), (6, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("vote", F.lit(1)).withColumn("k", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (1, None), (6, 0), (None, 0), (77, 0), (3, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    out = quality.scored(df, quality.fit(df, labels))
    assert sorted(out.columns) == sorted(df.columns)
    got = [r["score"] for r in out.orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert all(np.isfinite(got)) and got[1] == got[2] and min(got) >= 0 and max(got) <= 1


def test_no_preference_pairs_keeps_everything(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(2, 0)]):
        ranker = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r["score"] for r in quality.scored(df, ranker).collect()] == pytest.approx([0.7, 0.7])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.scored(none, quality.fit(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 0


def test_fit_sample_is_bounded(spark):
    df = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    ranker = quality.fit(df, labels, sample=10)
    assert len(ranker.weights) == len(quality.NAMES)


def test_cut_is_the_quantile():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] + draw.normal(size=400) > -0.5).astype(int)
    ranker = quality.fit_pairs(x, y)
    assert (ranker.score(x) < quality.ACCEPT).sum() == (y == 0).sum()
    assert ranker.weights[0] == max(ranker.weights)


def test_every_label_counts(spark):
    # more labels than the 20,000 that a fit once stopped at; the fit equals one in memory over all of them
    draw = np.random.default_rng(4)
    rows = [(i, "plain words " * int(draw.integers(1, 5)) + ("!! " if i % 37 == 0 else ""), int(i % 37 != 0 and draw.random() < 0.8)) for i in range(27_500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = np.array([quality.features(r[1]) for r in seen]), np.array([r[2] for r in seen])
    assert len(seen) > 20_000
    ranker = quality.fit(docs, labels)
    assert ranker.mean == pytest.approx(x.mean(axis=0), abs=1e-9)
    assert ranker.scale == pytest.approx(np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0)), abs=1e-9)
    raw = np.sort(ranker.raw(x))
    assert ranker.cut == pytest.approx((raw[(y == 0).sum() - 1] + raw[(y == 0).sum()]) / 2, abs=1e-9)
    assert np.corrcoef(ranker.raw(x), quality.fit_pairs(x, y).raw(x))[0, 1] > 0.99
    again = quality.fit(docs.repartition(2), labels.repartition(3))
    assert again.weights == pytest.approx(ranker.weights, abs=1e-8) and again.cut == pytest.approx(ranker.cut, abs=1e-8)


def test_value_at_every_place(spark):
    values = sorted([0.0] * 5 + [1e-9, 2.5, 2.5, 1e6, -3.0, -3.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.value_at(df, "v", i, bars=3) for i in range(len(values))] == values
