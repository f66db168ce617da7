"""The physical plans are the ones intended."""

import re

import pytest
from pyspark.sql import functions as F

from crosstide.catalog.common import panel, table
from crosstide.functions import rolling as ts
from crosstide.operators import cross_section, metrics
from crosstide.plans import feature_sets
from crosstide.sources import panel as panels

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    panels.weekly_panel(table(spark, SF, "lineitem")).write.parquet(path)
    return path


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = plan(panels.load_panel(spark, stored, "1996-01-01", "1996-12-31", ["close"]))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(datetime,1996-01-01\)", text)
    assert "ReadSchema: struct<datetime:date,instrument:bigint,close:double>" in text


def test_a_whole_factor_set_shuffles_once(spark, stored):
    df = panels.by_instrument(panels.load_panel(spark, stored))
    text = plan(feature_sets.factor_matrix(df, feature_sets.set_158()))
    assert len(re.findall(r"\) Exchange\n", text)) == 1
    assert "Python" not in text and "ArrowEval" not in text


def test_date_statistics_do_not_shuffle_the_panel(spark, stored):
    df = panels.load_panel(spark, stored, fields=["close"])
    text = plan(cross_section.with_zscore(df, "z", "close"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    # the only hash exchange carries partial aggregates, not panel rows
    assert len(exchanges) == 1 and "instrument" not in exchanges[0]


def test_top_holdings_are_limited_before_the_shuffle(spark, stored):
    df = panels.load_panel(spark, stored, fields=["close"])
    assert "WindowGroupLimit" in plan(metrics.top_holdings(df, "close", 50))


def test_daily_ic_pre_aggregates(spark):
    df = panel(spark, SF).select("datetime", "instrument", "ret", "close")
    assert "partial_covar_samp" in plan(metrics.daily_ic(df, "ret", "close"))


def test_no_plan_uses_a_cartesian_product(spark, stored):
    df = panels.load_panel(spark, stored, fields=["close", "volume"])
    out = cross_section.with_neutralised(df, "n", "close", "volume").withColumn("m", ts.mean("n", 3))
    assert "CartesianProduct" not in plan(out.where(F.col("m") > 0))


def test_a_factor_set_moves_structs_in_few_layers_and_shows_them_without_decimals(spark):
    from crosstide.catalog import factor_sets  # registers the queries
    from crosstide.catalog.common import QUERIES

    assert factor_sets
    text = plan(QUERIES["f02_alpha158"](spark, SF))
    assert len(re.findall(r"\) Window\n", text)) <= 7
    assert not re.search(r"round\(\(", text)


def test_a_factor_set_shuffles_and_sorts_its_order_lines_once(spark):
    from crosstide.catalog import factor_sets  # registers the queries
    from crosstide.catalog.common import QUERIES

    assert factor_sets
    text = plan(QUERIES["f02_alpha158"](spark, SF))
    assert len(re.findall(r"\) Exchange\n", text)) == 1 and len(re.findall(r"\) Sort\n", text)) == 1
    lines = table(spark, SF, "lineitem")
    once, twice = panels.weekly_panel(lines, at_once=True), panels.weekly_panel(lines)
    rows = lambda df: {r[:2]: r[2:] for r in df.collect()}
    got, wanted = rows(once), rows(twice)
    assert once.columns == twice.columns and got.keys() == wanted.keys()
    assert all(a[:5] == b[:5] and a[5] == pytest.approx(b[5]) for a, b in ((got[k], wanted[k]) for k in got))
