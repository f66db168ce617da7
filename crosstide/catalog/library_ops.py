"""Factor libraries, stores and
expression analytics on a library derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.common import panel, r, register, rs, table, with_panel
from crosstide.catalog.metric_ops import CHAIN, report
from crosstide.catalog.rolling_ops import KEYS, frame
from crosstide.functions import rolling as ts
from crosstide.operators import alignment, expressions, formulas, metrics
from crosstide.operators.lookups import with_row
from crosstide.session import cut_lineage, scratch_path, shuffle_width
from crosstide.sources import libraries, stores

# -- the library: text valid in both engines -----------------------------------

FEAT = "('$' || CASE p_partkey % 5 WHEN 0 THEN 'close' WHEN 1 THEN 'open' WHEN 2 THEN 'high' WHEN 3 THEN 'low' ELSE 'volume' END)"
W = "CAST(p_size AS STRING)"
N = "replace(p_brand, 'Brand#', '')"
EXPR = (
    "CASE p_partkey % 6 "
    f"WHEN 0 THEN 'RANK(TS_MEAN(' || {FEAT} || ', ' || {W} || ')) - RANK(TS_STD(' || {FEAT} || ', ' || {N} || '))' "
    f"WHEN 1 THEN '(' || {FEAT} || ' - TS_MIN($low, ' || {W} || ')) / (TS_MAX($high, ' || {W} || ') - TS_MIN($low, ' || {W} || ') + 1e-12)' "
    f"WHEN 2 THEN '($close > DELAY($close, ' || {N} || ')) ? (' || {FEAT} || ' * ' || {W} || ') : (-' || {FEAT} || ' / 2.5)' "
    f"WHEN 3 THEN 'TS_CORR(' || {FEAT} || ', $volume, ' || {W} || ') * (0.5 + TS_CORR($volume, ' || {FEAT} || ', ' || {W} || '))' "
    f"WHEN 4 THEN 'WHERE(' || {FEAT} || ' > TS_MEAN(' || {FEAT} || ', ' || {W} || ') && $volume != ' || {N} || ', LOG($volume), SQRT(' || {FEAT} || '))' "
    f"ELSE 'TS_MEAN($return, ' || {W} || ') / TS_STD($return, ' || {W} || ') + 0' END"
)
ID = "('f' || CAST(p_partkey AS STRING))"
RAW = {
    "factor_id": ID,
    "factor_name": "CASE WHEN p_partkey % 11 <> 0 THEN p_name END",
    "factor_expression": f"CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {EXPR} END",
    "factor_description": "p_type || ' on ' || p_brand",
    "quality": "CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'low' END",
}
IR = "(p_partkey % 10) / 10.0"
# metric key, when it is present, its value
METRICS = [
    ("IC", "p_partkey % 17 <> 0", "p_size / 100.0"),
    ("Rank IC", "p_partkey % 17 <> 0 AND p_partkey % 3 = 0", "p_retailprice / 10000.0"),
    ("rank_ic", "p_partkey % 17 <> 0 AND p_partkey % 3 = 1", "p_retailprice / 20000.0"),
    ("1day.excess_return_without_cost.information_ratio", "p_partkey % 17 <> 0 AND p_partkey % 4 = 0", IR),
    ("1day.excess_return_with_cost.information_ratio", "p_partkey % 17 <> 0 AND p_partkey % 4 = 1", IR),
    ("mine.information_ratio", "p_partkey % 17 <> 0 AND p_partkey % 4 = 2", IR),
]
PER_LIBRARY = 1000


def library_rows(spark, sf):
    """One row per part: factor columns, metric map, part key."""
    entries = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value")))
        for k, cond, v in METRICS
    ]))
    return table(spark, sf, "part").select(
        "p_partkey", *[F.expr(e).alias(c) for c, e in RAW.items()],
        F.map_from_entries(entries).alias("backtest_results"),
    )


LIB_SQL = (
    "lib AS (SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + ", "
    + ", ".join(f"CASE WHEN {c} THEN CAST({v} AS DOUBLE) END AS m{i}" for i, (_, c, v) in enumerate(METRICS))
    + " FROM part)",
    "facs AS (SELECT *, coalesce(factor_name, factor_id) AS name FROM lib WHERE factor_expression <> '')",
)


def with_lib(body: str, *more: str) -> str:
    return "WITH " + ",".join([*LIB_SQL, *more]) + " " + body


def write_libraries(spark, sf) -> str:
    """Indented library documents, one per file, of at most PER_LIBRARY factors each."""
    path = scratch_path(spark, "library")
    fields = ["factor_id", "factor_name", "factor_expression", "factor_description", "quality", "backtest_results"]
    rows = library_rows(spark, sf).withColumn(
        "backtest_results", F.map_concat(F.expr("CAST(backtest_results AS map<string,string>)"), F.create_map(F.lit("note"), F.lit("not run")))
    )
    rows = rows.withColumn("_lib", F.floor(F.col("p_partkey") / PER_LIBRARY))
    # part keys are distinct, so a block of keys bounds each document
    docs = rows.groupBy("_lib").agg(
        F.map_from_entries(F.collect_list(F.struct("factor_id", F.struct(*fields)))).alias("factors"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    meta = F.struct(F.col("n").alias("total_factors"), F.lit("2.0").alias("version"))
    text = F.to_json(F.struct(meta.alias("metadata"), "factors"), {"pretty": "true"})
    docs.select(text.alias("value"), "_lib").write.partitionBy("_lib").text(path)
    return path


def stored_library(spark, sf):
    return libraries.read_libraries(spark, write_libraries(spark, sf))


register(
    "s04_read_library",
    lambda spark, sf: stored_library(spark, sf).select(
        "factor_id", "factor_name", "factor_expression", "version",
        r(F.try_element_at("backtest_results", F.lit("IC"))).alias("ic"),
    ),
    with_lib(f"SELECT factor_id, name AS factor_name, factor_expression, '2.0' AS version, {rs('m0')} AS ic FROM facs"),
)


def zoo_csv(spark, sf):
    path = scratch_path(spark, "zoo")
    library_rows(spark, sf).where("factor_expression <> ''").select(
        F.coalesce("factor_name", "factor_id").alias("factor_name"), "factor_expression"
    ).write.option("header", True).option("escape", '"').csv(path)
    return libraries.read_factor_csv(spark, path)


register("s05_read_factor_csv", zoo_csv, with_lib("SELECT name AS factor_name, factor_expression FROM facs"))


def s07(spark, sf):
    paths = [write_libraries(spark, sf), write_libraries(spark, sf)]
    both = libraries.read_libraries(spark, paths[0]).withColumn("source", F.lit(0)).unionByName(
        libraries.read_libraries(spark, paths[1]).withColumn("source", F.lit(1))
    )
    return both.groupBy("source", "quality").agg(
        F.count(F.lit(1)).alias("factors"), F.max("factor_id").alias("last_id")
    )


register("s07_append_libraries", s07, with_lib(
    "SELECT CAST(s AS INT) AS source, quality, count(*) AS factors, max(factor_id) AS last_id FROM facs, range(2) t(s) GROUP BY 1, 2"))
register(
    "p09_quality_limit",
    lambda spark, sf: libraries.first_factors(
        libraries.with_quality(stored_library(spark, sf), "high"), 100, ["factor_id"]
    ).select("factor_id", "factor_name", "quality"),
    with_lib("SELECT factor_id, name AS factor_name, quality FROM facs WHERE quality = 'high' ORDER BY factor_id LIMIT 100"),
)
register(
    "p10_search",
    lambda spark, sf: libraries.search(
        stored_library(spark, sf), "Brand#1", ["factor_name", "factor_description", "factor_expression"]
    ).select("factor_id", "factor_description"),
    with_lib("SELECT factor_id, factor_description FROM facs WHERE contains(lower(name || '|' || factor_description || '|' || factor_expression), 'brand#1')"),
)
RATIO_SQL = "coalesce(m3, m4, m5)"
CLASS_SQL = (
    f"CASE WHEN coalesce(m0, m1, m2, m3, m4, m5) IS NULL THEN 'low' WHEN {RATIO_SQL} IS NULL THEN 'medium' "
    f"WHEN {RATIO_SQL} > 0.5 THEN 'high' WHEN {RATIO_SQL} > 0.1 THEN 'medium' ELSE 'low' END"
)
register(
    "p11_quality_class",
    lambda spark, sf: library_rows(spark, sf).select(
        "factor_id", libraries.quality_class("backtest_results").alias("class")
    ),
    with_lib(f"SELECT factor_id, {CLASS_SQL} AS class FROM lib"),
)
register(
    "p12_metric_aliases",
    lambda spark, sf: library_rows(spark, sf).select(
        "factor_id",
        r(libraries.metric("backtest_results", "ic")).alias("ic"),
        r(libraries.metric("backtest_results", "rank_ic")).alias("rank_ic"),
        r(libraries.metric("backtest_results", "information_ratio")).alias("ratio"),
    ),
    with_lib(f"SELECT factor_id, {rs('m0')} AS ic, {rs('coalesce(m1, m2)')} AS rank_ic, {rs('coalesce(m4, m3)')} AS ratio FROM lib"),
)


def p13(spark, sf):
    wild = F.when(F.col("p_size") > 40, float("inf")).when(F.col("p_size") < 5, float("nan")).otherwise(
        F.col("p_retailprice") / 7
    )
    metrics_map = F.create_map(F.lit("m"), wild)
    rows = table(spark, sf, "part").withColumn("m", metrics_map)
    return rows.select("p_partkey", F.element_at(libraries.stored_metrics("m"), "m").alias("value"))


register("p13_stored_metrics", p13,
         "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 THEN round(p_retailprice / 7, 8) END AS value FROM part")


def p14_sql() -> str:
    out = "factor_expression"
    for old, new in expressions.RENAMES:
        out = f"replace({out}, '{old}', '{new}')"
    bad = " OR ".join(f"contains(upper(f), '{t}')" for t in expressions.UNSUPPORTED)
    return with_lib(f"SELECT factor_id, CASE WHEN NOT ({bad}) THEN f END AS form FROM (SELECT factor_id, {out} AS f FROM facs)")


register(
    "p14_set_language",
    lambda spark, sf: library_rows(spark, sf).where("factor_expression <> ''").select(
        "factor_id", expressions.set_language_form(F.col("factor_expression")).alias("form")
    ),
    p14_sql(),
)

# -- stores --------------------------------------------------------------------

def s08(spark, sf):
    path = scratch_path(spark, "matrix")
    stores.write_matrix(panel(spark, sf), [
        ("MOM", ts.mean("ret", 5)), ("VOL", ts.std("ret", 10)), ("MOM", ts.mean("ret", 20))
    ], path)
    back = spark.read.parquet(path)
    return back.select(*KEYS, r("MOM").alias("MOM"), r("VOL").alias("VOL"))


register("s08_write_matrix", s08, with_panel(
    f'SELECT datetime, instrument, {rs(f"avg(ret) {frame(20)}")} AS "MOM", {rs(f"stddev_samp(ret) {frame(10)}")} AS "VOL" FROM panel'))


def s09(spark, sf):
    path = scratch_path(spark, "static")
    panel(spark, sf).where("volume > 25").select(*KEYS, "vwap").write.parquet(path)
    joined = stores.with_static(panel(spark, sf).select(*KEYS, "close"), spark.read.parquet(path), KEYS)
    return joined.select(*KEYS, r("close").alias("close"), r("vwap").alias("static"))


register("s09_static_features", s09, with_panel(
    f"SELECT datetime, instrument, {rs('close')} AS close, {rs('CASE WHEN volume > 25 THEN vwap END')} AS static FROM panel"))


def s09_bucketed(spark, sf):
    """Two stored matrices joined bucket by bucket."""
    base = panel(spark, sf)
    paths = [scratch_path(spark, n) for n in ("features", "static")]
    width = shuffle_width(spark)
    stores.write_bucketed(base.select(*KEYS, "close"), paths[0], width)
    stores.write_bucketed(base.where("volume > 25").select(*KEYS, "vwap"), paths[1], width)
    joined = stores.with_static(*(stores.read_bucketed(spark, p) for p in paths), KEYS)
    return joined.select(*KEYS, r("close").alias("close"), r("vwap").alias("static"))


register("s09_bucketed_join", s09_bucketed, with_panel(
    f"SELECT datetime, instrument, {rs('close')} AS close, {rs('CASE WHEN volume > 25 THEN vwap END')} AS static FROM panel"))
STORE = {
    "TS_MEAN($return,5)": (lambda: ts.mean("ret", 5), f"avg(ret) {frame(5)}"),
    "TS_SUM($volume,10)": (lambda: ts.total("volume", 10), f"sum(volume) {frame(10)}"),
    "TS_MAX($high,20)": (lambda: ts.maximum("high", 20), f"max(high) {frame(20)}"),
}


def s10(spark, sf):
    path = scratch_path(spark, "values")
    base = panel(spark, sf)
    names = list(STORE)
    stores.fill_store(base, {e: STORE[e][0]() for e in names[:2]}, path)
    added = stores.fill_store(base, {e: STORE[e][0]() for e in names[1:]}, path)
    return stores.read_store(spark, path, names[1:]).select(
        "expression_key", *KEYS, r("value").alias("value"),
        (F.col("expression_key").isin([stores.expression_key(e) for e in added])).alias("second_run"),
    )


register("s10_value_store", s10, with_panel(" UNION ALL ".join(
    f"SELECT md5('{e}') AS expression_key, datetime, instrument, {rs(STORE[e][1])} AS value, {i == 1} AS second_run FROM panel"
    for i, e in enumerate(list(STORE)[1:]))))


# name: (formula text, its SQL over the panel with ``m5``, the five-row mean of close)
TEXTS = {
    "trend": ("TS_MEAN($return, 5) / TS_STD($return, 20)", f"avg(ret) {frame(5)} / nullif(stddev_samp(ret) {frame(20)}, 0)"),
    "place": (
        "($close - TS_MIN($low, 10)) / (TS_MAX($high, 10) - TS_MIN($low, 10) + 1e-12)",
        f"(close - min(low) {frame(10)}) / nullif(max(high) {frame(10)} - min(low) {frame(10)} + 1e-12, 0)",
    ),
    "turn": (
        "$close > DELAY($close, 1) ? $volume : -$volume / 2.5",
        "CASE WHEN close > lag(close) OVER (PARTITION BY instrument ORDER BY datetime) THEN volume ELSE -volume / 2.5 END",
    ),
    "gate": (
        "WHERE($close > TS_MEAN($close, 5) && $volume != 30, LOG($volume), SQRT($close))",
        "CASE WHEN close > m5 AND volume <> 30 THEN ln(volume + 1) ELSE sqrt(close) END",
    ),
    "step": ("DELTA(TS_MEAN($close, 5), 2)", "m5 - lag(m5, 2) OVER (PARTITION BY instrument ORDER BY datetime)"),
    "rank": (
        "RANK($volume) - 0.5",
        "(rank() OVER (PARTITION BY datetime ORDER BY volume) + (count(*) OVER (PARTITION BY datetime, volume) - 1) / 2.0)"
        " / count(volume) OVER (PARTITION BY datetime) - 0.5",
    ),
    "score": (
        "ZSCORE(TS_MEAN($close, 5))",
        "(m5 - avg(m5) OVER (PARTITION BY datetime)) / nullif(stddev_samp(m5) OVER (PARTITION BY datetime), 0)",
    ),
    "rises": ("COUNT($return > 0, 10) + ($close >= $open)", f"sum(CAST(coalesce(ret > 0, false) AS INT)) {frame(10)} + CAST(close >= open AS INT)"),
}
register(
    "s14_formula_values",
    lambda spark, sf: formulas.with_values(panel(spark, sf), {n: text for n, (text, _) in TEXTS.items()}).select(
        *KEYS, *[r(n, 5).alias(n) for n in TEXTS]
    ),
    with_panel(
        "SELECT datetime, instrument, " + ", ".join(f"{rs(sql, 5)} AS {n}" for n, (_, sql) in TEXTS.items()) + " FROM means",
        f"means AS (SELECT *, avg(close) {frame(5)} AS m5 FROM panel)",
    ),
)



def s11(spark, sf):
    path = scratch_path(spark, "report")
    stores.write_report(metrics.with_cumulative(report(spark, sf)), path)
    back = stores.read_report(spark, path)
    summary = scratch_path(spark, "summary")
    for run in (1, 2):
        stores.append_summary(back.agg(F.count(F.lit(1)).alias("days")).withColumn("run", F.lit(run)), summary)
    runs = spark.read.schema("days long, run int").json(summary).agg(
        F.count(F.lit(1)).alias("runs"), F.max("days").alias("days")
    )
    return with_row(back, runs).select(
        "date", r("daily_excess_return").alias("daily"), r("cumulative_excess_return").alias("cumulative"), "runs", "days"
    )


register("s11_report_files", s11, with_panel(
    f"SELECT datetime AS date, {rs('excess')} AS daily, {rs('sum(excess) OVER (ORDER BY datetime)')} AS cumulative, "
    "CAST(2 AS BIGINT) AS runs, (SELECT count(*) FROM report) AS days FROM report", *CHAIN))


def s12(spark, sf):
    rows = library_rows(spark, sf).select(
        libraries.factor_id(F.coalesce("factor_name", "factor_id"), F.col("factor_expression")).alias("id"),
        F.coalesce("factor_name", "factor_id").alias("name"), "factor_expression", "quality",
        F.col("p_partkey").alias("version"),
    )
    old = rows.where("version % 2 = 0")
    newer = rows.where("version % 2 <> 0 OR version % 3 = 0").withColumn("version", F.col("version") + 1_000_000_000)
    path = scratch_path(spark, "library")
    for rows in (old, newer):
        libraries.upsert_store(rows, path, "id", "version", parts=8)
    return libraries.read_store(spark, path)


register("s12_upsert", s12, with_lib(
    "SELECT id, name, factor_expression, quality, version FROM (SELECT substr(md5(coalesce(factor_name, factor_id) || '_' || factor_expression), 1, 16) AS id, "
    "coalesce(factor_name, factor_id) AS name, factor_expression, quality, v AS version FROM (SELECT *, p_partkey AS v FROM lib WHERE p_partkey % 2 = 0 "
    "UNION ALL SELECT *, p_partkey + 1000000000 AS v FROM lib WHERE p_partkey % 2 <> 0 OR p_partkey % 3 = 0)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1"))

# -- summaries -----------------------------------------------------------------

def classed(spark, sf):
    return library_rows(spark, sf).select(
        "factor_id", libraries.quality_class("backtest_results").alias("class"),
        libraries.metric("backtest_results", "rank_ic").alias("rank_ic"),
    )


register(
    "a11_quality_counts",
    lambda spark, sf: libraries.quality_counts(classed(spark, sf), "class").select("class", "factors"),
    with_lib(f"SELECT {CLASS_SQL} AS class, count(*) AS factors FROM lib GROUP BY 1"),
)
register(
    "a11_best_factors",
    lambda spark, sf: libraries.best_factors(classed(spark, sf), "rank_ic", "factor_id").select(
        "factor_id", "class", r("rank_ic").alias("rank_ic")
    ),
    with_lib(f"SELECT factor_id, {CLASS_SQL} AS class, {rs('coalesce(m1, m2)')} AS rank_ic FROM lib "
             "ORDER BY coalesce(m1, m2) DESC NULLS LAST, factor_id LIMIT 10"),
)


def a12(spark, sf):
    status = F.when(F.col("p_partkey") % 3 == 0, "h5_cached").when(
        F.col("factor_expression") == "", "need_compute"
    )
    rows = library_rows(spark, sf).withColumn("key", F.md5("factor_expression")).withColumn("_s", status)
    known = rows.where("p_partkey % 5 = 0").select("key")
    marked = alignment.with_status(rows, known, "key", ["p_partkey"])
    final = F.coalesce("_s", F.when(F.col("cached"), "md5_cached").otherwise("need_compute"))
    return libraries.cache_summary(marked.withColumn("status", final), "status")


register("a12_cache_summary", a12, with_lib(
    "SELECT count(*) AS total, count(*) FILTER (WHERE s = 'h5_cached') AS h5_cached, count(*) FILTER (WHERE s = 'md5_cached') AS md5_cached, "
    "count(*) FILTER (WHERE s = 'need_compute') AS need_compute FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'h5_cached' "
    "WHEN factor_expression <> '' AND factor_expression IN (SELECT factor_expression FROM lib WHERE p_partkey % 5 = 0) THEN 'md5_cached' ELSE 'need_compute' END AS s FROM lib)"))


def o02(spark, sf):
    rows = stored_library(spark, sf)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy("factor_id").offset(40).limit(20)
    return with_row(page, total).select("factor_id", "factor_name", "total")


register("o02_page", o02, with_lib(
    "SELECT factor_id, name AS factor_name, (SELECT count(*) FROM facs) AS total FROM facs ORDER BY factor_id LIMIT 20 OFFSET 40"))


def o03(spark, sf):
    rows = library_rows(spark, sf)
    a = rows.where("p_partkey % 2 = 0").select("factor_description")
    c = rows.where("p_partkey % 2 <> 0 OR p_partkey % 3 = 0").select("factor_description")
    both = a.intersect(c).withColumn("part", F.lit("both"))
    return both.unionByName(a.unionByName(c).distinct().withColumn("part", F.lit("any")))


register("o03_set_operations", o03, with_lib(
    "SELECT factor_description, 'both' AS part FROM (SELECT factor_description FROM lib WHERE p_partkey % 2 = 0 INTERSECT SELECT factor_description FROM lib WHERE p_partkey % 2 <> 0 OR p_partkey % 3 = 0) "
    "UNION ALL SELECT DISTINCT factor_description, 'any' FROM lib"))

# -- expression analytics -------------------------------------------------------

def texts(spark, sf):
    return library_rows(spark, sf).where("factor_expression <> ''").select("p_partkey", "factor_expression")


E = "factor_expression"
register(
    "e01_symbol_length",
    lambda spark, sf: texts(spark, sf).select("p_partkey", expressions.symbol_length(F.col(E)).alias("length")),
    with_lib("SELECT p_partkey, CAST(length(trim(factor_expression)) AS INT) AS length FROM facs"),
)
register(
    "e02_base_features",
    lambda spark, sf: texts(spark, sf).select("p_partkey", expressions.base_features(F.col(E)).alias("features")),
    with_lib(r"SELECT p_partkey, CAST(len(list_distinct(regexp_extract_all(factor_expression, '\$\w+'))) AS INT) AS features FROM facs"),
)


def trees(spark, sf):
    return expressions.explode_subtrees(texts(spark, sf), "p_partkey", E, shuffle_width(spark))


# The six templates' subtrees, written out: f is the input, w and n are numbers.
_F, _W, _N = f"({FEAT})", "(CAST(p_size AS VARCHAR) || '.0')", "(replace(p_brand, 'Brand#', '') || '.0')"


def _call(name, *args):
    return f"('{name}(' || " + " || ',' || ".join(args) + " || ')')"


def _op(sign, a, b):
    return f"('(' || {a} || '{sign}' || {b} || ')')"


def _either(sign, a, b):
    return _op(sign, f"least({a}, {b})", f"greatest({a}, {b})")


def templates_sql():
    """(template, subtree, kind, size) of every node of every template, as one SELECT each."""
    out = []

    def leaf(text, kind):
        return text, kind, 1, []

    def node(text, kind, *below):
        return text, kind, 1 + sum(x[2] for x in below), list(below)

    def call(name, *below):
        return node(_call(name, *[x[0] for x in below]), "call", *below)

    def op(sign, a, b):
        return node((_either if sign in ("+", "*", "==", "!=", "&&") else _op)(sign, a[0], b[0]), "op", a, b)

    f, w, n = leaf(_F, "var"), leaf(_W, "num"), leaf(_N, "num")
    var, num = (lambda x: leaf(f"'${x}'", "var")), (lambda x: leaf(f"'{x}'", "num"))
    low, close, volume, ret = var("low"), var("close"), var("volume"), var("return")
    negative = node(f"('(-' || {_F} || ')')", "op", f)
    condition, then, other = op(">", close, call("DELAY", close, n)), op("*", f, w), op("/", negative, num("2.5"))
    trees = [
        op("-", call("RANK", call("TS_MEAN", f, w)), call("RANK", call("TS_STD", f, n))),
        op("/", op("-", f, call("TS_MIN", low, w)), op("+", op("-", call("TS_MAX", var("high"), w), call("TS_MIN", low, w)), num("1e-12"))),
        node(f"('(' || {condition[0]} || '?' || {then[0]} || ':' || {other[0]} || ')')", "cond", condition, then, other),
        op("*", call("TS_CORR", f, volume, w), op("+", num("0.5"), call("TS_CORR", volume, f, w))),
        call("WHERE", op("&&", op(">", f, call("TS_MEAN", f, w)), op("!=", volume, n)), call("LOG", volume), call("SQRT", f)),
        op("+", op("/", call("TS_MEAN", ret, w), call("TS_STD", ret, w)), num("0.0")),
    ]

    def walk(t, tree):
        out.append(f"SELECT p_partkey, {tree[0]} AS subtree, '{tree[1]}' AS kind, {tree[2]} AS size FROM part WHERE p_partkey % 6 = {t} AND p_partkey % 13 <> 0")
        for below in tree[3]:
            walk(t, below)

    for t, tree in enumerate(trees):
        walk(t, tree)
    return out


TREE_SQL = ("trees AS (SELECT p_partkey, subtree, md5(subtree) AS hash, kind, CAST(size AS INT) AS size FROM (" + " UNION ALL ".join(templates_sql()) + "))",)


def best_sql(name, new, zoo):
    """Tables ending in ``name``: each new key's largest subtree that another key of the zoo holds."""
    return (
        f"{name}_zoo AS (SELECT hash, min(p_partkey) AS first, min(CASE WHEN n = 2 THEN p_partkey END) AS second FROM "
        f"(SELECT hash, p_partkey, row_number() OVER (PARTITION BY hash ORDER BY p_partkey) AS n FROM (SELECT DISTINCT hash, p_partkey FROM ({zoo}))) GROUP BY 1)",
        f"{name} AS (SELECT p_partkey, size AS shared_size, subtree AS shared, other AS zoo_key FROM (SELECT t.p_partkey, size, subtree, "
        f"CASE WHEN first <> t.p_partkey THEN first ELSE second END AS other FROM ({new}) t JOIN {name}_zoo USING (hash)) WHERE other IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY size DESC, subtree DESC, other) = 1)",
    )


register("e05_subtree_explode", lambda spark, sf: trees(spark, sf), with_lib("SELECT * FROM trees", *TREE_SQL))
COUNTS_SQL = (
    "counts AS (SELECT p_partkey, count(*) FILTER (kind = 'num') AS constants, count(DISTINCT subtree) FILTER (kind = 'var') AS variables, "
    "count(*) AS nodes FROM trees GROUP BY 1)",
)
register(
    "e03_node_counts",
    lambda spark, sf: expressions.node_counts(trees(spark, sf), "p_partkey"),
    with_lib("SELECT p_partkey, constants, variables, nodes FROM counts", *TREE_SQL, *COUNTS_SQL),
)
register(
    "e05_subtree_sizes",
    lambda spark, sf: trees(spark, sf).groupBy("p_partkey").agg(
        F.max("size").alias("whole"), F.count(F.lit(1)).alias("subtrees"),
        F.count_if(F.col("kind") == "var").alias("inputs"),
        F.count_if(F.col("kind") == "call").alias("calls"),
    ),
    with_lib(
        "SELECT p_partkey, max(size) AS whole, count(*) AS subtrees, count(*) FILTER (kind = 'var') AS inputs, "
        "count(*) FILTER (kind = 'call') AS calls FROM trees GROUP BY 1", *TREE_SQL),
)


def e06(spark, sf):
    once = cut_lineage(trees(spark, sf))
    return expressions.largest_shared(once, once, "p_partkey")


register("e06_largest_shared_subtree", e06, with_lib("SELECT * FROM best", *TREE_SQL, *best_sql("best", "SELECT * FROM trees", "SELECT * FROM trees")))


def accepted(spark, sf):
    """Odd parts are the new expressions, even ones the zoo; a few new ones do not parse."""
    broken = F.when(F.col("p_partkey") % 26 == 1, F.concat(E, F.lit(" )"))).otherwise(F.col(E))
    every = texts(spark, sf).withColumn(E, broken)
    new = every.where("p_partkey % 2 = 1").withColumns(
        {"length": expressions.symbol_length(F.col(E)), "features": expressions.base_features(F.col(E))}
    )
    taken = cut_lineage(expressions.explode_subtrees(every, "p_partkey", E, shuffle_width(spark)))
    shared = expressions.largest_shared(taken.where("p_partkey % 2 = 1"), taken.where("p_partkey % 2 = 0"), "p_partkey")
    parsed = expressions.node_counts(taken, "p_partkey").withColumn("parsed", F.lit(True))
    facts = new.join(shared.select("p_partkey", "shared_size"), "p_partkey", "left").join(parsed, "p_partkey", "left")
    out = expressions.with_acceptance(facts, max_shared=9, max_length=90, max_features=3)
    return out.select("p_partkey", "accepted", "shared_size", F.array_join("reasons", ",").alias("reasons"))


REASONS = {
    "unparsable": "p_partkey % 26 = 1",
    "shared": "p_partkey % 26 <> 1 AND coalesce(shared_size, 0) > 9",
    "constants": "p_partkey % 26 <> 1 AND (constants >= nodes OR -ln(1 - constants / nodes) >= 0.693)",
    "variables": "p_partkey % 26 <> 1 AND (variables >= nodes OR -ln(1 - variables / nodes) >= 0.693)",
    "length": "length(factor_expression) + CASE WHEN p_partkey % 26 = 1 THEN 2 ELSE 0 END > 90",
    "features": "variables > 3",
}
register("e04_acceptance", accepted, with_lib(
    "SELECT p_partkey, reasons = '' AS accepted, shared_size, reasons FROM (SELECT p_partkey, shared_size, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REASONS.items())
    + ") AS reasons FROM facs JOIN counts USING (p_partkey) LEFT JOIN zoo_best USING (p_partkey) WHERE p_partkey % 2 = 1)",
    *TREE_SQL, *COUNTS_SQL,
    "parsing AS (SELECT * FROM trees WHERE p_partkey % 26 <> 1)",
    *best_sql("zoo_best", "SELECT * FROM parsing WHERE p_partkey % 2 = 1", "SELECT * FROM parsing WHERE p_partkey % 2 = 0")))


def named(spark, sf):
    return library_rows(spark, sf).where("factor_expression <> ''").select(
        "p_partkey", F.coalesce("factor_name", "factor_id").alias("name"), "factor_expression",
        F.col("quality") != "low",
    ).toDF("p_partkey", "name", "factor_expression", "viable")


register(
    "e07_drop_known_names",
    lambda spark, sf: expressions.drop_known_names(
        named(spark, sf).where("p_partkey % 2 = 1"),
        named(spark, sf).where("p_partkey % 2 = 0"), "name", ["p_partkey"],
    ).select("p_partkey", "name"),
    with_lib("SELECT p_partkey, name FROM facs WHERE p_partkey % 2 = 1 AND name NOT IN "
             "(SELECT name FROM facs WHERE p_partkey % 2 = 0)"),
)
register(
    "e08_keep_longest",
    lambda spark, sf: expressions.keep_longest(named(spark, sf), "name", E, "p_partkey").select("name", E, "p_partkey"),
    with_lib("SELECT name, factor_expression, p_partkey FROM facs QUALIFY row_number() OVER (PARTITION BY name "
             "ORDER BY length(factor_expression) DESC, p_partkey) = 1"),
)


def e09(spark, sf):
    rows = named(spark, sf).withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    replaced = rows.where("p_partkey % 37 = 0").select("name")
    return expressions.dedup_names(rows, replaced, "name", "viable", "p_partkey").select("p_partkey", "name")


register("e09_dedup_names", e09, with_lib(
    "SELECT p_partkey, name FROM n WHERE quality <> 'low' AND name NOT IN (SELECT name FROM n WHERE p_partkey % 37 = 0) "
    "QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) = 1",
    "n AS (SELECT p_partkey, quality, CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name END AS name FROM facs)"))
