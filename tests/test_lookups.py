"""Lookups broadcast only tables of few rows and few bytes."""

import pytest

from crosstide.operators import lookups


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_wide_rows_are_not_broadcast(spark, monkeypatch, how):
    left = spark.range(300).selectExpr("id % 7 AS k", "id AS row")
    right = spark.createDataFrame([(i, "x" * 2_000) for i in range(5)], "k long, text string")
    sent = lookups.lookup(left, right, ["k"], ["row"], how)
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 5_000)
    assert not lookups.is_small(right) and lookups.is_small(right.limit(2)) and not lookups.is_small(right, rows=4, size=10**9)
    dealt = lookups.lookup(left, right, ["k"], ["row"], how)
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in dealt._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, sent.fillna("-").collect())) == sorted(map(tuple, dealt.fillna("-").collect()))
    assert lookups.is_small(right.limit(0))
