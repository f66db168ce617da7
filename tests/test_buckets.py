"""Bucketed tables join without an exchange."""

import pytest

from crosstide.sources import stores


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_two_stored_matrices_join_without_an_exchange(spark, no_broadcast, tmp_path):
    days = spark.range(400).selectExpr("id % 40 AS instrument", "date_add(DATE'2020-01-01', int(id / 40)) AS datetime", "id * 1.5 AS `a b`")
    paths = [str(tmp_path / n) for n in ("left", "right")]
    stores.write_bucketed(days, paths[0], 4)
    stores.write_bucketed(days.where("instrument % 3 = 0").withColumnRenamed("a b", "label"), paths[1], 4)
    left, right = (stores.read_bucketed(spark, p) for p in paths)
    joined = stores.with_static(left, right, ["instrument", "datetime"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 400 and joined.where("label IS NOT NULL").count() == 140
    assert sorted(map(tuple, left.select("instrument", "datetime", "a b").collect())) == sorted(map(tuple, days.collect()))
    again = spark.newSession()
    assert stores.read_bucketed(again, paths[0]).count() == 400
    stores.write_bucketed(days.limit(0), paths[1], 4)
    assert stores.read_bucketed(spark, paths[1]).count() == 0
