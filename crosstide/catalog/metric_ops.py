"""Coefficients, portfolios, summaries, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.common import panel, r, register, rs, table, with_panel
from crosstide.catalog.panel_ops import DAILY_SQL, FOUR, FOUR_SQL, SCORED_SQL, four, pair_sql, rank_sql, scored
from crosstide.catalog.rolling_ops import KEYS
from crosstide.operators import checks, metrics
from crosstide.plans import backtest
from crosstide.session import cut_lineage

DAY = "datetime"

register(
    "a01_ic",
    lambda spark, sf: metrics.daily_ic(scored(spark, sf), "signal", "label").select(DAY, r("ic").alias("ic")),
    with_panel(
        f"SELECT datetime, {rs('covar_samp(signal, label) / nullif(stddev_samp(s) * stddev_samp(l), 0)')} AS ic FROM "
        "(SELECT *, CASE WHEN label IS NOT NULL THEN signal END AS s, CASE WHEN signal IS NOT NULL THEN label END AS l FROM scored) GROUP BY 1",
        SCORED_SQL),
)


def both_ic(spark, sf):
    df = scored(spark, sf)
    return metrics.daily_rank_ic(df, "signal", "label").join(metrics.daily_ic(df, "signal", "label"), DAY)


register(
    "a02_rank_ic",
    lambda spark, sf: metrics.daily_rank_ic(scored(spark, sf), "signal", "label").select(
        DAY, r("rank_ic").alias("rank_ic")
    ),
    with_panel(f"SELECT datetime, {rs('rank_ic')} AS rank_ic FROM daily", SCORED_SQL, *DAILY_SQL),
)
SUMMARY = ["ic_mean", "ic_ir", "rank_ic_mean", "rank_ic_ir"]
register(
    "a03_ic_summary",
    lambda spark, sf: metrics.ic_summary(both_ic(spark, sf), ["ic", "rank_ic"]).select(
        *[r(c).alias(c) for c in SUMMARY]
    ),
    with_panel(
        "SELECT " + ", ".join(
            f"{rs(f'avg({c})')} AS {c}_mean, {rs(f'coalesce(avg({c}) / nullif(stddev_samp({c}), 0), 0)')} AS {c}_ir"
            for c in ("ic", "rank_ic")) + " FROM daily",
        SCORED_SQL, *DAILY_SQL),
)
register(
    "a04_factor_correlation",
    lambda spark, sf: metrics.correlation_pairs(four(spark, sf), FOUR).select("a", "b", r("corr", 5).alias("corr")),
    with_panel(f"SELECT a, b, {rs('corr', 5)} AS corr FROM ({pair_sql('four', FOUR)})", FOUR_SQL),
)


def a05(spark, sf):
    df = four(spark, sf).withColumn("COPY", F.col("OPEN_RET") * 2 + 1).withColumn("LOOSE", F.col("CLOSE_RET"))
    over = metrics.overlap_with_kept(df, ["OPEN_RET", "VOL_RATIO"], ["COPY", "LOOSE", "RANGE_RET"])
    kept = metrics.not_redundant(over, 0.99).select("factor", F.lit(True).alias("kept"))
    return over.join(kept, "factor", "left").select(
        "factor", r("max_corr", 5).alias("max_corr"), F.coalesce("kept", F.lit(False)).alias("kept")
    )


def overlap_sql(new: str, kept: str) -> str:
    return (
        f"SELECT '{new}' AS factor, avg(c) AS m FROM (SELECT covar_samp({new}, {kept}) / nullif(stddev_samp(CASE WHEN {kept} IS NOT NULL "
        f"THEN {new} END) * stddev_samp(CASE WHEN {new} IS NOT NULL THEN {kept} END), 0) AS c FROM wide GROUP BY datetime)"
    )


register("a05_redundancy", a05, with_panel(
    f"SELECT factor, {rs('max(m)', 5)} AS max_corr, max(m) < 0.99 AS kept FROM ("
    + " UNION ALL ".join(overlap_sql(n, k) for n in ("COPY", "LOOSE", "RANGE_RET") for k in ("OPEN_RET", "VOL_RATIO"))
    + ") GROUP BY 1",
    FOUR_SQL, 'wide AS (SELECT *, "OPEN_RET" * 2 + 1 AS "COPY", "CLOSE_RET" AS "LOOSE" FROM four)'))

K = 50
TOP_SQL = (
    "top AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY signal DESC, instrument) AS place "
    f"FROM scored WHERE signal IS NOT NULL QUALIFY place <= {K})"
)
register(
    "a06_topk_portfolio",
    lambda spark, sf: metrics.portfolio_return(metrics.top_holdings(scored(spark, sf), "signal", K), "label").select(
        DAY, r("port_ret").alias("port_ret"), "held"
    ),
    with_panel(f"SELECT datetime, {rs('avg(label)')} AS port_ret, count(*) AS held FROM top GROUP BY 1", SCORED_SQL, TOP_SQL),
)
TURN_SQL = (
    "days AS (SELECT datetime, lead(datetime) OVER (ORDER BY datetime) AS nxt FROM (SELECT DISTINCT datetime FROM top))",
    "before AS (SELECT nxt AS datetime, instrument, 1 AS b FROM top JOIN days USING (datetime) WHERE nxt IS NOT NULL)",
    "flows AS (SELECT datetime, count(n) AS held, count(*) FILTER (WHERE b IS NULL) AS entered, "
    "count(*) FILTER (WHERE n IS NULL) AS \"left\" FROM (SELECT datetime, instrument, 1 AS n FROM top) "
    "FULL JOIN before USING (datetime, instrument) GROUP BY 1)",
    "costs AS (SELECT *, (entered * 0.0005 + \"left\" * 0.0015) / greatest(held, 1) AS cost FROM flows)",
)
register(
    "a07_turnover_cost",
    lambda spark, sf: metrics.turnover_cost(metrics.top_holdings(scored(spark, sf), "signal", K)).select(
        DAY, "held", "entered", "left", r("cost", 8).alias("cost")
    ),
    with_panel(f'SELECT datetime, held, entered, "left", {rs("cost", 8)} AS cost FROM costs', SCORED_SQL, TOP_SQL, *TURN_SQL),
)


def report(spark, sf):
    """Returns of this panel are wide; a hundredth keeps a compounded curve positive."""
    return backtest.daily_report(scored(spark, sf), "signal", "label", K, scale=0.01)


REPORT_SQL = (
    "report AS (SELECT datetime, coalesce(p / 100, 0) - coalesce(b / 100, 0) - coalesce(cost, 0) AS excess FROM "
    "(SELECT datetime, avg(label) AS p FROM top GROUP BY 1) JOIN costs USING (datetime) "
    "JOIN (SELECT datetime, avg(label) AS b FROM scored GROUP BY 1) USING (datetime))"
)
CHAIN = (SCORED_SQL, TOP_SQL, *TURN_SQL, REPORT_SQL)
register(
    "a08_excess_return",
    lambda spark, sf: report(spark, sf).select(DAY, r("excess").alias("excess")),
    with_panel(f"SELECT datetime, {rs('excess')} AS excess FROM report", *CHAIN),
)
register(
    "a09_cumulative",
    lambda spark, sf: metrics.with_cumulative(report(spark, sf)).select(DAY, r("cumulative").alias("cumulative")),
    with_panel(f"SELECT datetime, {rs('sum(excess) OVER (ORDER BY datetime)')} AS cumulative FROM report", *CHAIN),
)
RISK = ["annual_return", "information_ratio", "max_drawdown", "calmar"]


def a10(spark, sf):
    daily = report(spark, sf)
    plain = metrics.risk_metrics(daily).select(F.lit("sum").alias("form"), *RISK)
    grown = metrics.risk_metrics(daily, compound=True).select(F.lit("compound").alias("form"), *RISK)
    return plain.unionByName(grown).select("form", *[r(c, 5).alias(c) for c in RISK])


def risk_sql(form: str, worth: str, fall: str, annual: str) -> str:
    return (
        f"SELECT '{form}' AS form, {rs('ann', 5)} AS annual_return, {rs('ir', 5)} AS information_ratio, "
        f"{rs('mdd', 5)} AS max_drawdown, {rs('ann / nullif(abs(mdd), 0)', 5)} AS calmar FROM (SELECT {annual} AS ann, "
        f"avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(252) AS ir, min({fall}) AS mdd FROM (SELECT *, max(w) OVER (ORDER BY datetime) AS peak "
        f"FROM (SELECT *, {worth} AS w FROM report)))"
    )


register("a10_risk_metrics", a10, with_panel(
    risk_sql("sum", "sum(excess) OVER (ORDER BY datetime)", "w - peak", "avg(excess) * 252") + " UNION ALL "
    + risk_sql("compound", "product(1 + excess) OVER (ORDER BY datetime)", "w / peak - 1",
               "pow(product(1 + excess), 252.0 / count(*)) - 1"), *CHAIN))

# -- benchmark tables ---------------------------------------------------------------

EVALUATORS = ["row_count", "index", "equal_ratio", "correlation"]
# one run per order; its four evaluator results come from the order's numbers
METRIC_EXPRS = {
    "row_count": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1.0 END END",
    "index": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CASE WHEN o_custkey % 7 = 0 THEN 0.25 ELSE 1.0 END END",
    "equal_ratio": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 1000000.0 END",
    "correlation": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 500000.0 END",
}


def runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("factor"),
        F.col("o_orderkey").alias("run"),
        (F.col("o_orderstatus") == "F").alias("run_error"),
        *[F.expr(e).cast("double").alias(c) for c, e in METRIC_EXPRS.items()],
    )


RUNS_SQL = (
    "runs AS (SELECT o_orderpriority AS factor, o_orderkey AS run, o_orderstatus = 'F' AS run_error, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS \"{c}\"" for c, e in METRIC_EXPRS.items()) + " FROM orders)"
)
LABEL_TEXT = {
    "category": "CASE WHEN factor IN ('1-URGENT', '2-HIGH') THEN 'Fundamentals' WHEN factor = '3-MEDIUM' THEN 'High-Frequency' ELSE 'Volume&Price' END",
    "difficulty": "CASE WHEN factor = '1-URGENT' THEN 'Hard' WHEN factor = '5-LOW' THEN 'Easy' WHEN factor = '3-MEDIUM' THEN 'New Discovery' ELSE 'Medium' END",
}


def factor_labels(spark, sf):
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("factor")).distinct()
    return names.select("factor", *[F.expr(e).alias(c) for c, e in LABEL_TEXT.items()])


RATES = ["run_rate", "format_rate", "avg_corr", "max_corr", "avg_accuracy", "max_accuracy"]
NAMED_SQL = (
    "per AS (SELECT factor, avg(CASE WHEN run_error THEN 0.0 ELSE 1.0 END) AS run_rate, avg(f) AS format_rate, "
    "avg(CASE WHEN f = 1 THEN coalesce(correlation, 0) END) AS avg_corr, max(CASE WHEN f = 1 THEN coalesce(correlation, 0) END) AS max_corr, "
    "avg(equal_ratio * f) AS avg_accuracy, max(equal_ratio) AS max_accuracy "
    "FROM (SELECT *, (coalesce(row_count, 0) + coalesce(\"index\", 0)) / 2 AS f FROM runs) GROUP BY 1)",
    "named AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in LABEL_TEXT.items()) + " FROM per)",
)
register(
    "a14_benchmark_summary",
    lambda spark, sf: metrics.benchmark_summary(runs(spark, sf), factor_labels(spark, sf)).select(
        "level", "factor", "category", "difficulty", *[r(c).alias(c) for c in RATES]
    ),
    "WITH " + ",".join([RUNS_SQL, *NAMED_SQL])
    + " SELECT 'factor' AS level, factor, category, difficulty, " + ", ".join(f"{rs(c)} AS {c}" for c in RATES) + " FROM named"
    + " UNION ALL SELECT 'category', '-', category, '-', " + ", ".join(rs(f"avg({c})") for c in RATES) + " FROM named GROUP BY category"
    + " UNION ALL SELECT 'average', '-', '-', '-', " + ", ".join(rs(f"avg(coalesce({c}, 0))") for c in RATES) + " FROM named",
)
register(
    "a15_evaluator_pivot",
    lambda spark, sf: metrics.evaluator_table(
        metrics.evaluator_rows(runs(spark, sf), EVALUATORS), EVALUATORS
    ).select("factor", "run", *[r(c).alias(c) for c in EVALUATORS]),
    f"WITH {RUNS_SQL} SELECT factor, run, " + ", ".join(f'{rs(chr(34) + c + chr(34))} AS "{c}"' for c in EVALUATORS) + " FROM runs",
)


def a16(spark, sf):
    votes = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return metrics.majority(votes, "source", "quality")


register("a16_majority_vote", a16, """
SELECT source, count(*) FILTER (WHERE quality = 1) AS ones, count(*) FILTER (WHERE quality = 0) AS zeros,
  CASE WHEN count(*) FILTER (WHERE quality = 1) > count(*) FILTER (WHERE quality = 0) THEN 1 ELSE 0 END AS verdict
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")


def a17(spark, sf):
    base = panel(spark, sf)
    a = base.select(*KEYS, F.col("close").alias("value"))
    return metrics.mean_gap(a, base.select(*KEYS, F.col("vwap").alias("value")), KEYS, "value").select(
        r("mean_gap", 4).alias("mean_gap"), "passed"
    )


register("a17_mean_gap", a17, with_panel(
    f"SELECT {rs('avg(abs(close - vwap))', 4)} AS mean_gap, avg(abs(close - vwap)) < 0.1 AS passed FROM panel"))


def dims(spark, sf, shift):
    vecs = table(spark, sf, "embeddings")
    return vecs.select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("dim", "v")
    ).select("row", "dim", (F.col("v").cast("double") + shift).alias("value"))


register(
    "a18_dimension_corr",
    lambda spark, sf: metrics.mean_dimension_corr(
        dims(spark, sf, F.lit(0.0)), dims(spark, sf, F.pmod(F.col("row"), F.lit(7)) * 0.1)
    ).select(r("mean_corr").alias("mean_corr"), "dims"),
    f"""
WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))
SELECT {rs('avg(c)')} AS mean_corr, count(c) AS dims FROM (
  SELECT i, corr(v, v + (vec_id % 7) * 0.1) AS c FROM e GROUP BY 1)""",
)

# -- checks ---------------------------------------------------------------------------

PLACE = "(instrument * 7919 + datediff(datetime, DATE'1970-01-05') DIV 7)"
PLACE_SQL = "(instrument * 7919 + date_diff('day', DATE '1970-01-05', datetime) // 7)"


def two_tables(spark, sf):
    """The factor, and a copy with keys missing and values shifted at fixed places."""
    a = cut_lineage(panel(spark, sf).select(*KEYS, F.col("ret").alias("value")))
    b = a.where(F.expr(f"{PLACE} % 97 != 0")).withColumn(
        "value", F.expr(f"CASE WHEN {PLACE} % 89 = 0 THEN value + 1e-3 ELSE value END")
    )
    return a, b


TWO_SQL = (
    "ta AS (SELECT datetime, instrument, ret AS value FROM panel)",
    f"tb AS (SELECT datetime, instrument, CASE WHEN {PLACE_SQL} % 89 = 0 THEN value + 1e-3 ELSE value END AS value "
    f"FROM ta WHERE {PLACE_SQL} % 97 != 0)",
    "ab AS (SELECT *, a.instrument IS NOT NULL AS ia, b.instrument IS NOT NULL AS ib, a.value AS va, b.value AS vb "
    "FROM ta a FULL JOIN tb b ON a.datetime = b.datetime AND a.instrument = b.instrument)",
)


def checked(name, op, columns, sql) -> None:
    register(
        name,
        lambda spark, sf: op(*two_tables(spark, sf)).select(*columns),
        with_panel(sql, *TWO_SQL),
    )


def v01(spark, sf):
    wild = panel(spark, sf).select(
        *KEYS, F.when(F.col("volume") > 150, float("inf")).otherwise(F.col("volume")).alias("value")
    )
    return checks.infinite_count(wild)


register("v01_infinite", v01, with_panel("SELECT count(*) FILTER (WHERE volume > 150) AS infinite FROM panel"))


def v02(spark, sf):
    one = panel(spark, sf).select(*KEYS, "ret")
    many = panel(spark, sf).select(*KEYS, "ret", "close")
    return one.agg(
        F.count("ret").alias("present"),
        F.lit(checks.single_value_column(one)).alias("one_column"),
        F.lit(checks.single_value_column(many)).alias("two_columns"),
    )


register("v02_single_column", v02, with_panel(
    "SELECT count(ret) AS present, true AS one_column, false AS two_columns FROM panel"))


def v03(spark, sf):
    events = table(spark, sf, "events").select(F.date_trunc("minute", "ts").alias("datetime"))
    raw = table(spark, sf, "events").select(F.col("ts").alias("datetime"))
    daily = panel(spark, sf).select("datetime")
    tag = lambda df, t: checks.minute_gaps(df).select(F.lit(t).alias("grain"), "minute_gaps")
    return tag(events, "minute").unionByName(tag(raw, "event")).unionByName(tag(daily, "week"))


GAP_SQL = "SELECT '{0}' AS grain, count(*) FILTER (WHERE t - p = INTERVAL 1 MINUTE) AS minute_gaps FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT {1} AS t FROM {2}))"
register("v03_daily_grain", v03, with_panel(" UNION ALL ".join([
    GAP_SQL.format("minute", "date_trunc('minute', ts)", "events"),
    GAP_SQL.format("event", "ts", "events"),
    GAP_SQL.format("week", "CAST(datetime AS TIMESTAMP)", "panel")])))
checked("v04_row_ratio", checks.row_count_ratio, ["ratio"],
        "SELECT least(na, nb) / greatest(na, nb) AS ratio FROM (SELECT (SELECT count(*) FROM ta)::DOUBLE AS na, (SELECT count(*) FROM tb)::DOUBLE AS nb)")
checked("v05_key_jaccard", checks.key_overlap, ["jaccard"],
        "SELECT count(*) FILTER (WHERE ia AND ib)::DOUBLE / count(*) AS jaccard FROM ab")
checked("v06_missing_counts", checks.missing_counts, ["missing_a", "missing_b", "same"],
        "SELECT a AS missing_a, b AS missing_b, a = b AS same FROM (SELECT (SELECT count(*) FROM ta WHERE value IS NULL) AS a, (SELECT count(*) FROM tb WHERE value IS NULL) AS b)")
EQUAL_SQL = "count(*) FILTER (WHERE abs(va - vb) < 1e-6)::DOUBLE / count(*)"
checked("v07_equal_ratio", checks.equal_ratio, ["equal_ratio"], f"SELECT {EQUAL_SQL} AS equal_ratio FROM ab")
AGREE_SQL = (
    f"day AS (SELECT datetime, {rank_sql('va', 'datetime')} AS ra, {rank_sql('vb', 'datetime')} AS rb, va, vb FROM "
    "(SELECT coalesce(datetime, datetime_1) AS datetime, va, vb FROM ab WHERE va IS NOT NULL AND vb IS NOT NULL))",
    "agree AS (SELECT avg(c) AS ic, avg(d) AS rank_ic FROM (SELECT "
    "covar_samp(va, vb) / nullif(stddev_samp(va) * stddev_samp(vb), 0) AS c, "
    "covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) AS d FROM day GROUP BY datetime))",
)
register(
    "v08_agreement",
    lambda spark, sf: checks.agreement(*two_tables(spark, sf)).select(
        r("ic").alias("ic"), r("rank_ic").alias("rank_ic"), "passed"
    ),
    with_panel(
        f"SELECT {rs('ic')} AS ic, {rs('rank_ic')} AS rank_ic, ic > 0.99 AND rank_ic > 0.99 AS passed FROM agree",
        *TWO_SQL, *AGREE_SQL),
)


def v09(spark, sf):
    a, b = two_tables(spark, sf)
    tag = lambda x, y, t: checks.verdict(x, y).select(F.lit(t).alias("pair"), "verdict")
    half = b.withColumn("value", -F.col("value"))
    return tag(a, b, "close").unionByName(tag(a, half, "reversed")).unionByName(
        tag(a, a.withColumn("value", -F.col("value")), "same keys")
    )


register("v09_verdict", v09, with_panel(
    f"SELECT 'close' AS pair, CASE WHEN e > 0.99 OR (j > 0.99 AND p) THEN 'true' WHEN q <= 0.99 OR NOT s THEN 'false' ELSE 'undecided' END AS verdict FROM facts "
    "UNION ALL SELECT 'reversed', CASE WHEN q <= 0.99 OR NOT s THEN 'false' ELSE 'undecided' END FROM facts "
    "UNION ALL SELECT 'same keys', 'undecided'",
    *TWO_SQL, *AGREE_SQL,
    f"facts AS (SELECT {EQUAL_SQL} AS e, count(*) FILTER (WHERE ia AND ib)::DOUBLE / count(*) AS j, "
    "(SELECT ic > 0.99 AND rank_ic > 0.99 FROM agree) AS p, "
    "count(*) FILTER (WHERE ib)::DOUBLE / count(*) FILTER (WHERE ia) AS q, "
    "count(*) FILTER (WHERE ia AND va IS NULL) = count(*) FILTER (WHERE ib AND vb IS NULL) AS s FROM ab)"))
register(
    "v10_all_missing",
    lambda spark, sf: checks.all_missing(
        panel(spark, sf).select("ret", "xn", F.when(F.col("volume") < 0, F.col("close")).alias("never")),
        ["ret", "xn", "never"],
    ),
    with_panel(
        "SELECT 'ret' AS factor, count(ret) = 0 AS rejected FROM panel UNION ALL SELECT 'xn', count(xn) = 0 FROM panel "
        "UNION ALL SELECT 'never', count(CASE WHEN volume < 0 THEN close END) = 0 FROM panel"),
)
