"""S1-S3, S6, P1-P8, M, X, J and L1: panel sources, elementwise and
cross-sectional operators, alignment, dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.common import panel, r, register, rs, table, with_panel
from crosstide.catalog.rolling_ops import KEYS, frame, simple
from crosstide.functions import basics as b
from crosstide.functions import rolling as ts
from crosstide.operators import alignment, cross_section, metrics
from crosstide.plans import dataset, feature_sets
from crosstide.session import cut_lineage, scratch_path
from crosstide.sources import panel as panels

LABEL_SQL = (
    "lead(close, 2) OVER (PARTITION BY instrument ORDER BY datetime) / "
    "nullif(lead(close, 1) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1"
)


# -- flagship -------------------------------------------------------------------

def scored(spark, sf):
    """Volatility-scaled trend and forward return, the flagship's input.

    Ranking counts its groups before it plans, and a report reads the table
    several times; written down, the panel is built once for all of them.
    """
    signal = b.div(ts.mean("ret", 20), ts.std("ret", 20))
    table_ = panel(spark, sf).select(*KEYS, signal.alias("signal"), feature_sets.label().alias("label"))
    return cut_lineage(table_)


def stored_panel(spark, sf, *columns):
    """Some panel columns, written down for the same reason."""
    return cut_lineage(panel(spark, sf).select(*KEYS, *columns))


SCORED_SQL = (
    f"scored AS (SELECT datetime, instrument, avg(ret) {frame(20)} / nullif(stddev_samp(ret) {frame(20)}, 0)"
    f" AS signal, {LABEL_SQL} AS label FROM panel)"
)


def rank_sql(x: str, by: str = "datetime") -> str:
    """Average-tie rank in SQL, for tables without missing x."""
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + "
        f"(count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
    )


DAILY_SQL = (
    f"ranked AS (SELECT datetime, {rank_sql('signal')} AS rf, {rank_sql('label')} AS rl, signal, label "
    "FROM scored WHERE signal IS NOT NULL AND label IS NOT NULL)",
    "daily AS (SELECT datetime, covar_samp(signal, label) / nullif(stddev_samp(signal) * stddev_samp(label), 0) AS ic,"
    " covar_samp(rf, rl) / nullif(stddev_samp(rf) * stddev_samp(rl), 0) AS rank_ic FROM ranked GROUP BY 1)",
)

register(
    "flagship_rank_ic",
    lambda spark, sf: metrics.daily_rank_ic(scored(spark, sf), "signal", "label").select(
        "datetime", r("rank_ic").alias("rank_ic")
    ),
    with_panel(f"SELECT datetime, {rs('rank_ic')} AS rank_ic FROM daily", SCORED_SQL, *DAILY_SQL),
)

# -- sources ----------------------------------------------------------------------

def s01(spark, sf):
    path = scratch_path(spark, "panel")
    panels.weekly_panel(table(spark, sf, "lineitem")).write.parquet(path)
    universe = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("instrument")
    )
    loaded = panels.load_panel(
        spark, path, "1996-01-01", "1999-12-31", ["close", "volume"], universe
    )
    return loaded.select(*KEYS, r("close").alias("close"), r("volume").alias("volume"))


register("s01_load_panel", s01, with_panel(
    f"SELECT datetime, instrument, {rs('close')} AS close, {rs('volume')} AS volume FROM panel "
    "WHERE datetime BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' "
    "AND instrument IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
register(
    "s02_debug_panel",
    lambda spark, sf: panels.debug_panel(panel(spark, sf), 100).select(*KEYS, r("close").alias("close")),
    with_panel(
        f"SELECT datetime, instrument, {rs('close')} AS close FROM panel WHERE instrument IN "
        "(SELECT DISTINCT instrument FROM panel ORDER BY instrument LIMIT 100)"),
)
simple("s03_return", {"ret": (lambda: F.col("ret"), "ret")})


def s06(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("datetime"),
        F.col("l_suppkey").alias("instrument"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    kept = panels.keep_last(rows, KEYS, ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"])
    return kept.select(*KEYS, "l_orderkey", "l_linenumber", r("l_extendedprice", 2).alias("price"))


register("s06_dedup_keep_last", s06, f"""
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime, l_suppkey AS instrument,
       l_orderkey, l_linenumber, {rs('l_extendedprice', 2)} AS price
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY date_trunc('week', l_shipdate), l_suppkey
  ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1""")

# -- elementwise --------------------------------------------------------------------

simple("p01_arithmetic", {
    "a": (lambda: b.add("xn", "vwap"), "xn + vwap"),
    "s": (lambda: b.subtract("xn", "vwap"), "xn - vwap"),
    "m": (lambda: b.multiply("ret", "volume"), "ret * volume"),
    "d": (lambda: b.div("xn", F.col("volume") - 30), "xn / nullif(volume - 30, 0)"),
}, 4)


def p02(spark, sf):
    ops = {"gt": b.gt, "lt": b.lt, "ge": b.ge, "le": b.le, "eq": b.eq, "ne": b.ne}
    return panel(spark, sf).select(
        *KEYS,
        *[op("xn", "yn").alias(name) for name, op in ops.items()],
        b.lt(F.lit(1000.0), "xn").alias("scalar_left"),
    )


register("p02_comparisons", p02, with_panel(
    "SELECT datetime, instrument, coalesce(xn > yn, false) AS gt, coalesce(xn < yn, false) AS lt, "
    "coalesce(xn >= yn, false) AS ge, coalesce(xn <= yn, false) AS le, coalesce(xn = yn, false) AS eq, "
    "coalesce(xn != yn, true) AS ne, coalesce(1000.0 < xn, false) AS scalar_left FROM panel"))
register(
    "p03_and_or",
    lambda spark, sf: panel(spark, sf).select(
        *KEYS,
        b.both(b.gt("close", "open"), b.gt("volume", F.lit(60))).alias("both"),
        b.either(b.gt("xn", "open"), b.gt("volume", F.lit(60))).alias("either"),
    ),
    with_panel(
        "SELECT datetime, instrument, close > open AND volume > 60 AS both, "
        "coalesce(xn > open, false) OR volume > 60 AS either FROM panel"),
)
simple("p04_where", {
    "w": (lambda: b.where(F.col("xn") > F.col("open"), "ret", F.lit(-1.0)),
          "CASE WHEN xn > open THEN ret ELSE -1 END"),
})
simple("p05_filter", {
    "f": (lambda: b.keep_if("xn", b.gt("close", "open")),
          "CASE WHEN xn IS NOT NULL THEN CASE WHEN close > open THEN xn ELSE 0 END END"),
})
SEGMENTS = {
    "train": ("1995-01-01", "1998-12-31"),
    "valid": ("1999-01-01", "1999-12-31"),
    "test": ("2000-01-01", "2001-12-31"),
}


def p06(spark, sf):
    part = panels.between(panel(spark, sf), "1995-01-01", "2001-06-30")
    return panels.with_segment(part, SEGMENTS).select(*KEYS, "segment")


register("p06_segments", p06, with_panel(
    "SELECT datetime, instrument, CASE "
    + " ".join(f"WHEN datetime BETWEEN DATE '{s}' AND DATE '{e}' THEN '{n}'" for n, (s, e) in SEGMENTS.items())
    + " END AS segment FROM panel WHERE datetime >= DATE '1995-01-01' AND datetime <= DATE '2001-06-30'"))


def p07(spark, sf):
    universe = table(spark, sf, "supplier").where("s_nationkey < 12").select(
        F.col("s_suppkey").alias("instrument")
    )
    return panel(spark, sf).join(universe, "instrument", "left_semi").select(*KEYS, r("close").alias("close"))


register("p07_universe", p07, with_panel(
    f"SELECT datetime, instrument, {rs('close')} AS close FROM panel "
    "WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = instrument AND s_nationkey < 12)"))


def p08(spark, sf):
    base = panel(spark, sf)
    prices = base.where("volume < 200").select(*KEYS, F.col("xn").alias("price"))
    signal = base.select(*KEYS, "ret").join(prices, KEYS, "left")
    usable = F.col("price").isNotNull() & (F.col("price") != 0)
    return signal.select(*KEYS, r(F.when(usable, F.col("ret"))).alias("signal"))


register("p08_price_mask", p08, with_panel(
    f"SELECT datetime, instrument, {rs('CASE WHEN volume < 200 AND xn <> 0 THEN ret END')} AS signal FROM panel"))

simple("m01_abs", {"v": (lambda: b.absolute("ret"), "abs(ret)")})
simple("m02_sign", {"v": (lambda: b.sign("ret"), "sign(ret)")})
simple("m03_exp", {"v": (lambda: b.exp(-F.abs("ret")), "exp(-abs(ret))")})
simple("m04_sqrt", {"v": (lambda: b.sqrt("ret"), "CASE WHEN ret >= 0 THEN sqrt(ret) END")})
simple("m05_log", {"v": (lambda: b.log1p(F.col("ret") - 0.5), "CASE WHEN ret - 0.5 > -1 THEN ln(ret + 0.5) END")})
simple("m06_inv", {"v": (lambda: b.inverse(F.col("volume") - 30), "1 / nullif(volume - 30, 0)")})
simple("m07_pow", {
    "square": (lambda: b.power("ret", 2), "pow(ret, 2)"),
    "root": (lambda: b.power("ret", 0.5), "CASE WHEN ret >= 0 THEN pow(ret, 0.5) END"),
}, 5)
simple("m08_floor", {"v": (lambda: b.floor(F.col("ret") * 10), "floor(ret * 10)")})
simple("m09_max_min", {
    "hi": (lambda: b.larger("xn", "yn", "open"),
           "CASE WHEN xn IS NOT NULL AND yn IS NOT NULL THEN greatest(xn, yn, open) END"),
    "lo": (lambda: b.smaller("xn", "yn"),
           "CASE WHEN xn IS NOT NULL AND yn IS NOT NULL THEN least(xn, yn) END"),
})
simple("m10_sequence", {
    "beta": (lambda: ts.beta("volume", None, 12),
             f"CASE WHEN rn >= 12 THEN covar_pop(volume, rn) {frame(12)} / nullif(var_pop(rn) {frame(12)}, 0) END"),
})
simple("m11_fill_zero", {"v": (lambda: b.fill_zero("xn"), "coalesce(xn, 0)")})

# -- cross-section --------------------------------------------------------------------

def crossed(name: str, columns: dict, digits: int = 6, stored: bool = False) -> None:
    """{column: (operator, arguments, SQL over the panel)} in one query."""

    def query(spark, sf):
        df = stored_panel(spark, sf, "xn") if stored else panel(spark, sf)
        for c, (op, args, _) in columns.items():
            df = op(df, c, *args)
        return df.select(*KEYS, *[r(c, digits).alias(c) for c in columns])

    body = ", ".join(f"{rs(sql, digits)} AS {c}" for c, (_, _, sql) in columns.items())
    register(name, query, with_panel(f"SELECT datetime, instrument, {body} FROM panel"))


D = "OVER (PARTITION BY datetime)"
XRANK = (
    "CASE WHEN xn IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY xn NULLS LAST) + "
    f"(count(*) OVER (PARTITION BY datetime, xn) - 1) / 2.0) / count(xn) {D} END"
)
crossed("x01_rank", {"v": (cross_section.with_rank, ["xn"], XRANK)}, stored=True)
crossed("x02_mean", {"v": (cross_section.with_mean, ["xn"], f"avg(xn) {D}")}, 4)
crossed("x03_std", {"v": (cross_section.with_std, ["xn"], f"stddev_samp(xn) {D}")}, 4)


def moment(x: str, power: int, least: int) -> str:
    c = f"avg({x}) {D}"
    seen = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {D}"
    m = lambda k: f"list_avg(list_transform({seen}, lambda v: pow(v - {c}, {k})))"
    shift = " - 3" if power == 4 else ""
    return f"CASE WHEN count({x}) {D} >= {least} THEN {m(power)} / nullif(pow({m(2)}, {power / 2}), 0){shift} END"


crossed("x04_skew", {"v": (cross_section.with_skew, ["xn"], moment("xn", 3, 3))})
crossed("x05_kurt", {"v": (cross_section.with_kurt, ["xn"], moment("xn", 4, 4))})
crossed("x06_max_min", {
    "hi": (cross_section.with_max, ["xn"], f"max(xn) {D}"),
    "lo": (cross_section.with_min, ["xn"], f"min(xn) {D}"),
})
crossed("x07_median", {"v": (cross_section.with_median, ["xn"], f"median(xn) {D}")}, stored=True)
crossed("x08_zscore", {
    "v": (cross_section.with_zscore, ["xn"], f"(xn - avg(xn) {D}) / nullif(stddev_samp(xn) {D}, 0)"),
})
crossed("x09_scale", {
    "one": (cross_section.with_scale, ["ret"], f"ret / nullif(sum(abs(ret)) {D}, 0)"),
    "ten": (cross_section.with_scale, ["xn", 10.0], f"xn * 10 / nullif(sum(abs(xn)) {D}, 0)"),
})
register(
    "x10_centred_rank",
    lambda spark, sf: cross_section.with_centred_ranks(stored_panel(spark, sf, "xn", "ret"), {"a": "xn", "b": "ret"}).select(
        *KEYS, r("a").alias("a"), r("b").alias("b")
    ),
    with_panel(
        f"SELECT datetime, instrument, {rs(f'CASE WHEN count(*) {D} = 1 THEN 0 ELSE {XRANK} - 0.5 END')} AS a, "
        + rs(f"CASE WHEN count(*) {D} = 1 THEN 0 ELSE {XRANK} - 0.5 END".replace("xn", "ret"))
        + " AS b FROM panel"),
)
crossed("x11_fill_mean", {"v": (cross_section.with_filled_mean, ["xn"], f"coalesce(xn, avg(xn) {D}, 0)")}, 4)


def with_capital(spark, sf):
    capital = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("instrument"), F.col("s_acctbal").alias("capital")
    )
    return panel(spark, sf).join(capital, "instrument", "left")


register(
    "x12_neutralise",
    lambda spark, sf: cross_section.with_neutralised(
        with_capital(spark, sf).withColumn("change", b.div("volume", ts.delay("volume", 20)) - 1),
        "v", "change", "capital",
    ).select(*KEYS, r("v").alias("v")),
    with_panel(
        f"SELECT datetime, instrument, {rs(f'(e - avg(e) {D}) / nullif(stddev_samp(e) {D}, 0)')} AS v FROM resid",
        "f AS (SELECT datetime, instrument, volume / nullif(lag(volume, 20) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1 AS c, "
        "s_acctbal AS m FROM panel LEFT JOIN supplier ON s_suppkey = instrument)",
        f"g AS (SELECT datetime, instrument, coalesce(c, avg(c) {D}, 0) AS c, coalesce(m, avg(m) {D}, 0) AS m FROM f)",
        "line AS (SELECT regr_slope(c, m) AS k, regr_intercept(c, m) AS c0 FROM g)",
        "resid AS (SELECT datetime, instrument, c - c0 - k * m AS e FROM g, line)"),
)
register(
    "x13_rank_difference",
    lambda spark, sf: cross_section.with_rank_difference(stored_panel(spark, sf, "volume", "close"), "v", "volume", "close").select(
        *KEYS, r("v").alias("v")
    ),
    with_panel(f"SELECT datetime, instrument, {rs(rank_sql('volume') + ' - ' + rank_sql('close'))} AS v FROM panel"),
)

# -- joins -----------------------------------------------------------------------------

def j01(spark, sf):
    base = panel(spark, sf)
    label = base.select(*KEYS, feature_sets.label().alias("label")).where("label IS NOT NULL")
    joined = alignment.with_label_only(base.select(*KEYS, "ret"), label)
    return joined.select(*KEYS, r("ret").alias("ret"), r("label").alias("label"))


register("j01_features_label", j01, with_panel(
    f"SELECT datetime, instrument, {rs('ret')} AS ret, {rs('label')} AS label FROM "
    f"(SELECT *, {LABEL_SQL} AS label FROM panel) WHERE label IS NOT NULL"))


def j02(spark, sf):
    base = panel(spark, sf)
    a = base.where("volume >= 40").select(*KEYS, F.col("close").alias("f1"))
    c = base.where("volume <= 160").select(*KEYS, F.col("open").alias("f2"), F.lit(0.0).alias("f1"))
    d = base.where("close > open").select(*KEYS, F.col("high").alias("f3"))
    return alignment.merge_outer([a, c, d]).select(*KEYS, *[r(x).alias(x) for x in ("f1", "f2", "f3")])


register("j02_outer_align", j02, with_panel(
    "SELECT datetime, instrument, " + ", ".join(f"{rs(x)} AS {x}" for x in ("f1", "f2", "f3"))
    + " FROM (SELECT datetime, instrument, close AS f1 FROM panel WHERE volume >= 40) a "
    "FULL JOIN (SELECT datetime, instrument, open AS f2 FROM panel WHERE volume <= 160) b USING (datetime, instrument) "
    "FULL JOIN (SELECT datetime, instrument, high AS f3 FROM panel WHERE close > open) c USING (datetime, instrument)"))


def j03(spark, sf):
    base = panel(spark, sf)
    enough = base.where("volume >= 30").select(*KEYS, "ret")
    few = base.where("volume >= 5000").select(*KEYS, "ret")
    pick = lambda df, tag: df.select(*KEYS, F.lit(tag).alias("source"), r("ret").alias("ret"))
    return pick(alignment.align_to(base, enough), "enough").unionByName(
        pick(alignment.align_to(base, few), "few")
    )


register("j03_align_gate", j03, with_panel(
    f"SELECT datetime, instrument, 'enough' AS source, {rs('CASE WHEN volume >= 30 THEN ret END')} AS ret FROM panel "
    "WHERE (SELECT avg(CASE WHEN volume >= 30 THEN 1 ELSE 0 END) FROM panel) > 0.5 UNION ALL "
    f"SELECT datetime, instrument, 'few', {rs('CASE WHEN volume >= 5000 THEN ret END')} FROM panel "
    "WHERE (SELECT avg(CASE WHEN volume >= 5000 THEN 1 ELSE 0 END) FROM panel) > 0.5"))


def j04(spark, sf):
    # order totals exist for some days only, so weeks must look back
    series = table(spark, sf, "orders").groupBy(
        (F.date_trunc("month", "o_orderdate").cast("date") + 2).alias("datetime")
    ).agg(F.max("o_totalprice").alias("bench"))
    return alignment.with_series(panel(spark, sf), series, "bench", "bench").select(
        *KEYS, r("bench", 2).alias("bench")
    )


register("j04_asof_series", j04, with_panel(
    f"SELECT p.datetime, instrument, {rs('bench', 2)} AS bench FROM panel p ASOF LEFT JOIN s ON p.datetime >= s.datetime",
    "s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) + 2 AS datetime, max(o_totalprice) AS bench "
    "FROM orders GROUP BY 1)"))


def parts_key(spark, sf, low, high):
    return table(spark, sf, "part").where(F.col("p_size").between(low, high)).select(
        F.md5(F.concat_ws("_", "p_name", "p_brand")).alias("key"), "p_partkey"
    )


def j05(spark, sf):
    wanted, known = parts_key(spark, sf, 13, 10**9), parts_key(spark, sf, 0, 20)
    marked = alignment.with_status(wanted, known, "key", ["p_partkey"])
    todo = alignment.missing_from(wanted, known, "key", ["p_partkey"]).select("p_partkey", F.lit(True).alias("todo"))
    return marked.join(todo, "p_partkey", "left").select(
        "p_partkey", "key", "cached", F.coalesce("todo", F.lit(False)).alias("todo")
    )


register("j05_cached_status", j05, """
WITH k AS (SELECT p_partkey, p_size, md5(p_name || '_' || p_brand) AS key FROM part),
known AS (SELECT DISTINCT key FROM k WHERE p_size <= 20)
SELECT p_partkey, k.key, known.key IS NOT NULL AS cached, known.key IS NULL AS todo
FROM k LEFT JOIN known ON k.key = known.key WHERE p_size >= 13""")

FOUR = ["OPEN_RET", "VOL_RATIO", "RANGE_RET", "CLOSE_RET"]


def four(spark, sf):
    return feature_sets.factor_matrix(panel(spark, sf), feature_sets.baseline_4())


FOUR_SQL = (
    f"four AS (SELECT datetime, instrument, close / open - 1 AS \"OPEN_RET\", volume / avg(volume) {frame(20)} AS \"VOL_RATIO\", "
    "(high - low) / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS \"RANGE_RET\", ret AS \"CLOSE_RET\" FROM panel)"
)


def pair_sql(source: str, names, group: str = "") -> str:
    parts = []
    for i, a in enumerate(names):
        for c in names[i + 1:]:
            parts.append(
                f"SELECT {group}'{a}' AS a, '{c}' AS b, covar_samp({a}, {c}) / nullif("
                f"stddev_samp(CASE WHEN {c} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {c} END), 0)"
                f" AS corr FROM {source}" + (" GROUP BY datetime" if group else "")
            )
    return " UNION ALL ".join(parts)


register(
    "j06_factor_pairs",
    lambda spark, sf: four(spark, sf).groupBy("datetime").agg(
        *[metrics.pearson(x, y).alias(f"{x}__{y}") for i, x in enumerate(FOUR) for y in FOUR[i + 1:]]
    ).unpivot("datetime", None, "pair", "corr").select("datetime", "pair", r("corr", 5).alias("corr")),
    with_panel(
        f"SELECT datetime, a || '__' || b AS pair, {rs('corr', 5)} AS corr FROM (" + pair_sql("four", FOUR, "datetime, ") + ")",
        FOUR_SQL),
)


def metric_table(spark, sf, done):
    part = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") == done)
    return part.groupBy(F.concat("o_orderpriority", F.year("o_orderdate").cast("string")).alias("metric")).agg(
        F.avg("o_totalprice").alias("value")
    )


register(
    "j08_current_vs_best",
    lambda spark, sf: alignment.compare_metrics(
        metric_table(spark, sf, False), metric_table(spark, sf, True),
    ).select("metric", r("current", 2).alias("current"), r("best", 2).alias("best"), "larger"),
    f"""
WITH m AS (SELECT o_orderstatus = 'F' AS s, o_orderpriority || CAST(year(o_orderdate) AS VARCHAR) AS metric, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)
SELECT metric, {rs('a.value', 2)} AS current, {rs('b.value', 2)} AS best,
  CASE WHEN a.value > b.value THEN 'current' ELSE 'best' END AS larger
FROM (SELECT * FROM m WHERE NOT s) a FULL JOIN (SELECT * FROM m WHERE s) b USING (metric)""",
)

# -- dataset ---------------------------------------------------------------------------

def centred_sql(x: str) -> str:
    return f"CASE WHEN count(*) {D} = 1 THEN 0 ELSE {rank_sql(x)} / count(*) {D} - 0.5 END"


register(
    "l01_dataset",
    lambda spark, sf: dataset.prepare(
        cut_lineage(feature_sets.factor_matrix(
            panel(spark, sf).withColumn("label", feature_sets.label()), feature_sets.baseline_4(), ["label"]
        )),
        FOUR, "label",
    ).select(*KEYS, *[r(c).alias(c) for c in [*FOUR, "label"]]),
    with_panel(
        "SELECT datetime, instrument, " + ", ".join(f"{rs(c)} AS \"{c}\"" for c in FOUR)
        + f", {rs(centred_sql('label'))} AS label FROM ranked WHERE label IS NOT NULL",
        FOUR_SQL,
        "filled AS (SELECT datetime, instrument, label, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FOUR)
        + f" FROM four JOIN (SELECT datetime, instrument, {LABEL_SQL} AS label FROM panel) USING (datetime, instrument))",
        "ranked AS (SELECT datetime, instrument, label, " + ", ".join(f"{centred_sql(c)} AS {c}" for c in FOUR) + " FROM filled)"),
)
