"""Time-series operators on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.common import panel, r, register, rs, with_panel
from crosstide.functions import basics as b
from crosstide.functions import rolling as ts
from crosstide.operators import smoothing
from crosstide.operators.smoothing import Ewm

KEYS = ["datetime", "instrument"]


def frame(p: int) -> str:
    """SQL text of a rolling frame."""
    return f"OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


HIST = "OVER (PARTITION BY instrument ORDER BY datetime)"


def simple(name: str, columns: dict, digits: int = 6) -> None:
    """Register a query whose columns are {name: (Column builder, SQL)}."""

    def query(spark, sf):
        return panel(spark, sf).select(
            *KEYS, *[r(build(), digits).alias(c) for c, (build, _) in columns.items()]
        )

    body = ", ".join(f"{rs(sql, digits)} AS {c}" for c, (_, sql) in columns.items())
    register(name, query, with_panel(f"SELECT datetime, instrument, {body} FROM panel"))


def lagged(x: str, p: int = 1) -> str:
    return f"lag({x}, {p}) {HIST}"


simple("t01_delta", {
    "d1": (lambda: ts.delta("close"), f"close - {lagged('close')}"),
    "d5": (lambda: ts.delta("xn", 5), f"xn - {lagged('xn', 5)}"),
})
simple("t02_delay", {
    "l1": (lambda: ts.delay("close"), lagged("close")),
    "l10": (lambda: ts.delay("xn", 10), lagged("xn", 10)),
})
simple("t03_ts_pctchange", {
    "c1": (lambda: ts.pct_change("close"), f"coalesce(close / nullif({lagged('close')}, 0) - 1, 0)"),
    "c3": (lambda: ts.pct_change("xn", 3), f"coalesce(xn / nullif({lagged('xn', 3)}, 0) - 1, 0)"),
})
simple("t04_ts_mean", {
    "m5": (lambda: ts.mean("xn"), f"avg(xn) {frame(5)}"),
    "m20": (lambda: ts.mean("close", 20), f"avg(close) {frame(20)}"),
}, 4)
simple("t05_ts_sum", {
    "s5": (lambda: ts.total("xn"), f"sum(xn) {frame(5)}"),
    "sumac10": (lambda: ts.total("volume", 10), f"sum(volume) {frame(10)}"),
}, 4)
simple("t06_ts_std", {
    "s20": (lambda: ts.std("xn"), f"stddev_samp(xn) {frame(20)}"),
    "s5": (lambda: ts.std("ret", 5), f"stddev_samp(ret) {frame(5)}"),
}, 5)
simple("t07_ts_var", {
    "v1": (lambda: ts.var("ret", 5), f"var_samp(ret) {frame(5)}"),
    "v0": (lambda: ts.var("ret", 10, 0), f"var_pop(ret) {frame(10)}"),
    "v2": (
        lambda: ts.var("ret", 10, 2),
        f"CASE WHEN count(ret) {frame(10)} > 2 THEN var_pop(ret) {frame(10)} * count(ret) {frame(10)}"
        f" / (count(ret) {frame(10)} - 2) END",
    ),
})
simple("t08_ts_max_min", {
    "hi": (lambda: ts.maximum("xn"), f"max(xn) {frame(5)}"),
    "lo": (lambda: ts.minimum("xn", 10), f"min(xn) {frame(10)}"),
})
simple("t09_ts_median", {
    "med5": (lambda: ts.median("xn"), f"quantile_cont(xn, 0.5) {frame(5)}"),
    "med20": (lambda: ts.median("close", 20), f"quantile_cont(close, 0.5) {frame(20)}"),
}, 5)
simple("t10_ts_quantile", {
    "q20": (lambda: ts.quantile("xn", 20, 0.2), f"quantile_cont(xn, 0.2) {frame(20)}"),
    "swapped": (lambda: ts.quantile("xn", 0.8, 10), f"quantile_cont(xn, 0.8) {frame(10)}"),
}, 5)
simple("t11_percentile", {
    "rolling": (lambda: ts.percentile("xn", 0.3, 15), f"quantile_cont(xn, 0.3) {frame(15)}"),
    "whole": (
        lambda: ts.percentile("xn", 0.9),
        "quantile_cont(xn, 0.9) OVER (PARTITION BY instrument)",
    ),
}, 5)


def rank_sql(x: str, p: int) -> str:
    seen = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {frame(p)}"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter({seen}, lambda v: v < {x})) + "
        f"(len(list_filter({seen}, lambda v: v = {x})) + 1) / 2.0) / len({seen}) END"
    )


simple("t12_ts_rank", {
    "r5": (lambda: ts.rank("xn"), rank_sql("xn", 5)),
    "r20": (lambda: ts.rank("volume", 20), rank_sql("volume", 20)),
})
simple("t13_ts_zscore", {
    "z5": (
        lambda: ts.zscore("xn"),
        f"(xn - avg(xn) {frame(5)}) / nullif(stddev_samp(xn) {frame(5)}, 0)",
    ),
    "z20": (
        lambda: ts.zscore("volume", 20),
        f"(volume - avg(volume) {frame(20)}) / nullif(stddev_samp(volume) {frame(20)}, 0)",
    ),
})


def moment_sql(x: str, p: int, power: int, least: int) -> str:
    seen = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {frame(p)}"
    mean = f"list_avg({seen})"
    m = lambda k: f"list_avg(list_transform({seen}, lambda v: pow(v - {mean}, {k})))"
    shift = " - 3" if power == 4 else ""
    return f"CASE WHEN len({seen}) >= {least} THEN {m(power)} / nullif(pow({m(2)}, {power / 2}), 0){shift} END"


simple("t14_ts_skew", {"s10": (lambda: ts.skew("ret", 10), moment_sql("ret", 10, 3, 3))}, 5)
simple("t15_ts_kurt", {"k10": (lambda: ts.kurt("ret", 10), moment_sql("ret", 10, 4, 4))}, 5)
SEEN10 = f"list(xn) FILTER (WHERE xn IS NOT NULL) {frame(10)}"
simple("t16_ts_mad", {
    "mad10": (
        lambda: ts.mad("xn", 10),
        f"list_median(list_transform({SEEN10}, lambda v: abs(v - list_median({SEEN10}))))",
    ),
}, 5)
ARGMAX = f"rn - arg_max(rn, (xn, -rn)) FILTER (WHERE xn IS NOT NULL) {frame(10)}"
ARGMIN = f"rn - arg_min(rn, (xn, rn)) FILTER (WHERE xn IS NOT NULL) {frame(10)}"
simple("t17_ts_argmax_argmin", {
    "since_max": (lambda: ts.argmax("xn", 10), ARGMAX),
    "since_min": (lambda: ts.argmin("xn", 10), ARGMIN),
})
simple("t18_highday_lowday", {
    "highday": (lambda: ts.highday("xn", 10), ARGMAX + " + 1"),
    "lowday": (lambda: ts.lowday("xn", 10), ARGMIN + " + 1"),
})
simple("t19_count", {
    "n": (
        lambda: ts.count_if(b.gt("close", "open")),
        f"sum(CAST(coalesce(close > open, false) AS INT)) {frame(20)}",
    ),
})
simple("t20_sumif", {
    "s": (
        lambda: ts.sum_if("volume", 10, b.gt("xn", "open")),
        f"sum(volume * CAST(coalesce(xn > open, false) AS INT)) {frame(10)}",
    ),
})
simple("t21_prod", {
    "p5": (
        lambda: ts.product(F.col("ret") + 1, 5),
        f"CASE WHEN count(ret) {frame(5)} = count(*) {frame(5)} THEN product(ret + 1) {frame(5)} END",
    ),
    "scaled": (lambda: ts.product("ret", 2.5), "ret * 2.5"),
})


def corr_sql(x: str, y: str, p: int) -> str:
    px, py = (f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END")
    return (
        f"covar_samp({x}, {y}) {frame(p)} / nullif(stddev_samp({px}) {frame(p)}"
        f" * stddev_samp({py}) {frame(p)}, 0)"
    )


simple("t22_ts_corr", {
    "c10": (lambda: ts.corr("xn", "volume", 10), corr_sql("xn", "volume", 10)),
    "c5": (lambda: ts.corr("xn", "yn", 5), corr_sql("xn", "yn", 5)),
}, 5)
simple("t23_ts_corr_sequence", {
    "c8": (
        lambda: ts.corr_time("xn", 8),
        f"CASE WHEN count(xn) {frame(8)} = count(*) {frame(8)} AND count(*) {frame(8)} >= 2"
        f" THEN coalesce({corr_sql('xn', 'rn', 8)}, 0) END",
    ),
}, 5)
simple("t24_ts_covariance", {
    "v10": (lambda: ts.covariance("ret", "volume", 10), f"covar_samp(ret, volume) {frame(10)}"),
    "seq": (
        lambda: ts.covariance_time("ret", 6),
        f"CASE WHEN count(ret) {frame(6)} = count(*) {frame(6)} THEN covar_samp(ret, rn) {frame(6)} END",
    ),
}, 5)


def slope_sql(y: str, x: str, p: int) -> str:
    return f"covar_pop({y}, {x}) {frame(p)} / nullif(var_pop({x}) {frame(p)}, 0)"


R0, V0 = "coalesce(ret, 0)", "coalesce(xn, 0)"
simple("t25_regbeta", {
    "b8": (lambda: ts.beta("ret", "xn", 8), f"CASE WHEN rn >= 8 THEN {slope_sql(R0, V0, 8)} END"),
    "bt": (lambda: ts.beta("ret", None, 6), f"CASE WHEN rn >= 6 THEN {slope_sql(R0, 'rn', 6)} END"),
})
simple("t26_regresi", {
    "e8": (
        lambda: ts.residual("ret", "xn", 8),
        f"CASE WHEN rn >= 8 THEN {R0} - (avg({R0}) {frame(8)} + {slope_sql(R0, V0, 8)}"
        f" * ({V0} - avg({V0}) {frame(8)})) END",
    ),
    "et": (
        lambda: ts.residual("ret", None, 6),
        f"CASE WHEN rn >= 6 THEN {R0} - (avg({R0}) {frame(6)} + {slope_sql(R0, 'rn', 6)}"
        f" * (rn - avg(rn) {frame(6)})) END",
    ),
})


def ewm_sql(x: str, alpha: float, source: str = "panel") -> str:
    """Table (datetime, instrument, v) of an adjusted exponential average."""
    keep = f"pow(1 - {alpha!r}, a.rn - b.rn)"
    return (
        f"SELECT a.datetime, a.instrument, sum({keep} * b.{x}) / nullif(sum({keep}) "
        f"FILTER (WHERE b.{x} IS NOT NULL), 0) AS v FROM {source} a JOIN {source} b "
        f"ON a.instrument = b.instrument AND b.rn <= a.rn GROUP BY 1, 2"
    )


def sma_query(spark, sf):
    base = panel(spark, sf).select(*KEYS, "xn", ts.sma("xn", 7).alias("m7"))
    return smoothing.with_ewm(base, {"e": Ewm("xn", alpha=2 / 9)}).select(
        *KEYS, r("m7", 4).alias("m7"), r("e", 4).alias("e")
    )


register("t27_sma", sma_query, with_panel(
    f"SELECT p.datetime, p.instrument, {rs('m7', 4)} AS m7, {rs('v', 4)} AS e FROM "
    f"(SELECT datetime, instrument, avg(xn) {frame(7)} AS m7 FROM panel) p "
    f"JOIN ewm USING (datetime, instrument)", f"ewm AS ({ewm_sql('xn', 2 / 9)})"))

register(
    "t28_ema",
    lambda spark, sf: smoothing.select_ewm(
        panel(spark, sf), KEYS, {"e5": Ewm("xn", span=5), "e12": Ewm("ret", span=12)}
    ).select(*KEYS, r("e5", 4).alias("e5"), r("e12").alias("e12")),
    with_panel(
        f"SELECT datetime, instrument, {rs('a.v', 4)} AS e5, {rs('b.v')} AS e12 "
        "FROM a JOIN b USING (datetime, instrument)",
        f"a AS ({ewm_sql('xn', 2 / 6)})", f"b AS ({ewm_sql('ret', 2 / 13)})"),
)


def weighted_sql(x: str, p: int, weight: str) -> str:
    return f"list_sum(list_transform(list({x}) {frame(p)}, lambda v, i: v * {weight}))"


SEEN_WMA = f"list(xn) {frame(10)}"
simple("t29_wma", {
    "w10": (
        lambda: ts.wma("xn", 10),
        f"CASE WHEN count(xn) {frame(10)} = count(*) {frame(10)} THEN "
        f"list_sum(list_transform({SEEN_WMA}, lambda v, i: v * pow(0.9, len({SEEN_WMA}) - i))) / "
        f"list_sum(list_transform({SEEN_WMA}, lambda v, i: pow(0.9, len({SEEN_WMA}) - i))) END",
    ),
}, 4)
simple("t30_decaylinear", {
    "d5": (
        lambda: ts.decay_linear("xn", 5),
        f"CASE WHEN count(xn) {frame(5)} = count(*) {frame(5)} THEN {weighted_sql('xn', 5, 'i')} / 15.0 END",
    ),
}, 4)
register(
    "t31_macd",
    lambda spark, sf: smoothing.with_macd(
        panel(spark, sf).select(*KEYS, "close"), "macd", "close", 12, 26
    ).select(*KEYS, r("macd", 4).alias("macd")),
    with_panel(
        f"SELECT datetime, instrument, {rs('a.v - b.v', 4)} AS macd FROM a JOIN b USING (datetime, instrument)",
        f"a AS ({ewm_sql('close', 2 / 13)})", f"b AS ({ewm_sql('close', 2 / 27)})"),
)
register(
    "t32_rsi",
    lambda spark, sf: smoothing.with_rsi(
        panel(spark, sf).select(*KEYS, "close"), "rsi", "close", 14
    ).select(*KEYS, r("rsi", 5).alias("rsi")),
    with_panel(
        f"SELECT datetime, instrument, {rs('CASE WHEN d.v = 0 AND u.v > 0 THEN 100 ELSE 100 - 100 / nullif(1 + u.v / nullif(d.v, 0), 0) END', 5)} AS rsi "
        "FROM u JOIN d USING (datetime, instrument)",
        f"steps AS (SELECT datetime, instrument, rn, close - {lagged('close')} AS s FROM panel)",
        "moves AS (SELECT *, CASE WHEN s > 0 THEN s WHEN s <= 0 THEN 0 END AS up,"
        " CASE WHEN s < 0 THEN -s WHEN s >= 0 THEN 0 END AS down FROM steps)",
        f"u AS ({ewm_sql('up', 2 / 15, 'moves')})", f"d AS ({ewm_sql('down', 2 / 15, 'moves')})"),
)
simple("t33_bollinger", {
    "mid": (lambda: ts.band_middle("xn", 12), f"avg(xn) {frame(12)}"),
    "up": (lambda: ts.band_upper("xn", 12), f"avg(xn) {frame(12)} + stddev_samp(xn) {frame(12)}"),
    "low": (lambda: ts.band_lower("xn", 12), f"avg(xn) {frame(12)} - stddev_samp(xn) {frame(12)}"),
}, 4)


def varying(spark, sf):
    width = F.col("volume") % 20
    mid, up, low = ts.varying_bands("xn", width, 20)
    return panel(spark, sf).select(
        *KEYS, r(mid, 4).alias("mid"), r(up, 4).alias("up"), r(low, 4).alias("low")
    )


register("t34_bollinger_varying", varying, with_panel(
    f"SELECT a.datetime, a.instrument, {rs('avg(b.xn)', 4)} AS mid, "
    f"{rs('avg(b.xn) + stddev_samp(b.xn)', 4)} AS up, {rs('avg(b.xn) - stddev_samp(b.xn)', 4)} AS low "
    "FROM panel a JOIN panel b ON a.instrument = b.instrument AND b.rn <= a.rn "
    "AND b.rn > a.rn - greatest(CAST(floor(a.volume % 20) AS INT), 1) GROUP BY 1, 2"))
FULL20 = f"CASE WHEN count(turnover) {frame(20)} = 20 THEN avg(turnover) {frame(20)} END"


def turnover(spark, sf):
    from crosstide.catalog.common import table

    capital = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("instrument"), F.col("s_acctbal").alias("capital")
    )
    daily = panel(spark, sf).join(capital, "instrument", "left").withColumn(
        "turnover", b.div("volume", "capital")
    )
    window = ts.last_rows(20)
    full = F.when(F.count("turnover").over(window) == 20, F.avg("turnover").over(window))
    return daily.select(*KEYS, r(b.div(full, "capital"), 9).alias("rate"))


register("t35_turnover_rate", turnover, with_panel(
    f"SELECT datetime, instrument, {rs(FULL20 + ' / nullif(capital, 0)', 9)} AS rate FROM f",
    "f AS (SELECT p.*, s_acctbal AS capital, volume / nullif(s_acctbal, 0) AS turnover "
    "FROM panel p LEFT JOIN supplier ON s_suppkey = instrument)"))

# -- operators of the named factor sets --------------------------------------
simple("q01_ref", {
    "back": (lambda: ts.delay("close", 3), lagged("close", 3)),
    "forward": (lambda: ts.ahead("close", 2), f"lead(close, 2) {HIST}"),
})
simple("q02_window_stats", {
    "mean_v": (lambda: ts.mean("volume", 10), f"avg(volume) {frame(10)}"),
    "std_v": (lambda: ts.std("ret", 10), f"stddev_samp(ret) {frame(10)}"),
    "var_v": (lambda: ts.var("ret", 10), f"var_samp(ret) {frame(10)}"),
    "sum_v": (lambda: ts.total("volume", 10), f"sum(volume) {frame(10)}"),
    "max_v": (lambda: ts.maximum("high", 10), f"max(high) {frame(10)}"),
    "min_v": (lambda: ts.minimum("low", 10), f"min(low) {frame(10)}"),
})
TIME = "CASE WHEN xn IS NOT NULL THEN rn END"
simple("q03_slope", {"b10": (lambda: ts.slope("xn", 10), slope_sql("xn", TIME, 10))}, 5)
simple("q04_rsquare", {"r10": (lambda: ts.rsquare("xn", 10), f"pow({corr_sql('xn', 'rn', 10)}, 2)")}, 5)
simple("q05_resi", {
    "e10": (
        lambda: ts.trend_residual("xn", 10),
        f"xn - (avg(xn) {frame(10)} + {slope_sql('xn', TIME, 10)} * ({TIME} - avg({TIME}) {frame(10)}))",
    ),
}, 4)
simple("q06_quantile", {"q30": (lambda: ts.quantile("close", 30, 0.8), f"quantile_cont(close, 0.8) {frame(30)}")}, 5)
simple("q07_rank", {"r10": (lambda: ts.rank("close", 10), rank_sql("close", 10))})
simple("q08_idxmax_idxmin", {
    "imax": (
        lambda: ts.index_of_max("high", 10),
        f"arg_max(rn, (high, -rn)) {frame(10)} - min(rn) {frame(10)} + 1",
    ),
    "imin": (
        lambda: ts.index_of_min("low", 10),
        f"arg_min(rn, (low, rn)) {frame(10)} - min(rn) {frame(10)} + 1",
    ),
})
simple("q09_corr", {
    "c20": (lambda: ts.corr("close", b.ln(F.col("volume") + 1), 20), corr_sql("close", "ln(volume + 1)", 20)),
}, 5)
simple("q10_greater_less", {
    "g": (lambda: b.larger("xn", "yn"), "CASE WHEN xn IS NOT NULL AND yn IS NOT NULL THEN greatest(xn, yn) END"),
    "l": (lambda: b.smaller("xn", "yn"), "CASE WHEN xn IS NOT NULL AND yn IS NOT NULL THEN least(xn, yn) END"),
})
simple("q11_log_abs_share", {
    "lg": (lambda: b.ln("volume"), "CASE WHEN volume > 0 THEN ln(volume) END"),
    "ab": (lambda: b.absolute("ret"), "abs(ret)"),
    "up": (
        lambda: ts.share_true(F.col("close") > ts.delay("close"), 10),
        f"avg(CASE WHEN ret IS NOT NULL THEN CAST(close > close / (1 + ret) AS INT) END) {frame(10)}",
    ),
})
