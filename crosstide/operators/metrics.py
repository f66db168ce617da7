"""Information coefficients, portfolios, risk figures and benchmark summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import div, fill_zero
from crosstide.operators import ranking


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate over complete pairs; NULL for a constant side."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return div(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def daily_ic(df: DataFrame, factor: str, label: str, name: str = "ic") -> DataFrame:
    return df.groupBy("datetime").agg(pearson(factor, label).alias(name))


def daily_rank_ic(
    df: DataFrame, factor: str, label: str, name: str = "rank_ic", hot_rows: int = ranking.HOT_ROWS
) -> DataFrame:
    """Spearman per date, ranks taken among rows that have both values."""
    paired = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(
        "datetime", "instrument", factor, label
    )
    ranked = ranking.with_ranks(
        paired,
        {"_rf": factor, "_rl": label},
        pct=False,
        hot_rows=hot_rows,
        biggest=ranking.largest_group(df, ["datetime"]),
    )
    return daily_ic(ranked, "_rf", "_rl", name)


def ic_summary(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and mean-over-deviation of daily coefficients, one row."""
    out = []
    for c in columns:
        out += [
            F.avg(c).alias(f"{c}_mean"),
            F.coalesce(div(F.avg(c), F.stddev_samp(c)), F.lit(0.0)).alias(f"{c}_ir"),
        ]
    return daily.agg(*out)


def _gram(factors: Sequence[str], centres: Sequence[float]):
    """Sums of a task's rows for every two factors, over the rows that have both."""
    middle = np.array(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(factors)
        sums = np.zeros((5, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]) - middle
            there = np.isfinite(x)
            x, there = np.where(there, x, 0.0), there.astype("float64")
            sums += [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, x.T @ x]
        at, to = np.triu_indices(k)
        cells = [pa.array(at.astype("int32")), pa.array(to.astype("int32"))]
        squares = [pa.array(s[at, to]) for s in (*sums, sums[3].T)]
        yield pa.RecordBatch.from_arrays([*cells, *squares], ["i", "j", "n", "x", "y", "xx", "xy", "yy"])

    return run


def correlation_pairs(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(a, b, corr) over all rows, for every two factors.

    Matrix products of each Arrow batch add up to sums per pair in every task,
    so the shuffle carries one row per pair and task.  Values are taken from
    the factors' means first, which keeps the sums of squares exact enough.
    """
    names = list(factors)
    values = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(names)])
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in values.columns]
    centres = [0.0 if m is None else m for m in values.agg(*[F.avg(c) for c in finite]).first()]
    sums = ("n", "x", "y", "xx", "xy", "yy")
    schema = "i int, j int, " + ", ".join(f"{c} double" for c in sums)
    parts = values.mapInArrow(_gram(names, centres), schema).where("i < j")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    c = F.col
    left, right = c("xx") - c("x") * c("x") / c("n"), c("yy") - c("y") * c("y") / c("n")
    corr = div(c("xy") - c("x") * c("y") / c("n"), F.sqrt(F.greatest(left, F.lit(0.0)) * F.greatest(right, F.lit(0.0))))
    name = F.array(*map(F.lit, names))
    return total.select(
        F.element_at(name, c("i") + 1).alias("a"), F.element_at(name, c("j") + 1).alias("b"),
        F.when(c("n") > 1, corr).alias("corr"),
    )


#: Rows of a date that are multiplied together; a longer date is dealt into parts.
PART_ROWS = 20_000
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _between(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sums of ``_SUMS`` for every column of ``left`` with every one of ``right``, over rows that have both."""
    there, here = np.isfinite(left), np.isfinite(right)
    x, y = np.where(there, left, 0.0), np.where(here, right, 0.0)
    p, q = there.astype("float64"), here.astype("float64")
    return np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])


def _correlation(sums: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Correlations from the sums; NaN below two rows and where a side varies by rounding alone."""
    n, x, y, xx, yy, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = xx - x * x / n, yy - y * y / n
        plain = (n < 2) | (left <= n * noise[0]) | (right <= n * noise[1])
        return np.where(plain, np.nan, (xy - x * y / n) / np.sqrt(left * right))


def _overlaps(new: int, centres: Sequence[float]):
    """Per date and part the products of new with kept columns.

    A date in one part adds its correlations to sums of the task; the sums of
    products of a date in several parts go on as a row per pair.
    """
    middle = np.array(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(middle) - new
        total, dates = np.zeros((new, kept)), np.zeros((new, kept))
        at, to = (i.ravel() for i in np.indices((new, kept)))
        names = ["day", "i", "j", *_SUMS, "corr", "days", "noise_x", "noise_y"]

        def row(day: int | None, sums: np.ndarray | None, corr: np.ndarray, days: np.ndarray, noise: np.ndarray) -> pa.RecordBatch:
            flat = [pa.array(a.ravel()) if a is not None else pa.nulls(new * kept, pa.float64()) for a in (sums if sums is not None else [None] * 6)]
            ends = [pa.array(np.broadcast_to(a, (new, kept)).ravel()) for a in (corr, days, noise[0], noise[1])]
            return pa.RecordBatch.from_arrays([pa.array([day] * (new * kept), pa.int64()), pa.array(at), pa.array(to), *flat, *ends], names)

        def done(day: int, parts: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            scale = np.max(np.where(np.isfinite(values), np.abs(values), 0.0), axis=0, initial=0.0) ** 2 * 1e-28
            noise = np.broadcast_to(scale[:new, None], (new, kept)), np.broadcast_to(scale[None, new:], (new, kept))
            if parts > 1:
                values = values - middle
                yield row(day, _between(values[:, :new], values[:, new:]), np.zeros(1), np.zeros(1), noise)
                return
            count = np.maximum(np.isfinite(values).sum(axis=0), 1)
            values = values - np.where(np.isfinite(values), values, 0.0).sum(axis=0) / count
            corr = _correlation(_between(values[:, :new], values[:, new:]), noise)
            np.add(total, np.nan_to_num(corr), out=total)
            np.add(dates, np.isfinite(corr), out=dates)

        held: list[np.ndarray] = []
        last: tuple[int, int, int] | None = None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]).astype("float64")
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if last is not None and key != last:
                    yield from done(last[0], last[2], np.concatenate(held))
                    held = []
                held.append(values[a:b])
                last = key
        if last is not None:
            yield from done(last[0], last[2], np.concatenate(held))
        zero = np.zeros((new, kept))
        yield row(None, None, total, dates, (zero, zero))

    return run


def overlap_with_kept(df: DataFrame, kept: Sequence[str], new: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """(factor, max_corr): for each new factor the largest mean daily
    correlation with a kept factor.

    Rows are dealt by date (a date of more than ``part_rows`` rows in parts),
    and every date is one matrix product of all new with all kept columns, so
    the plan does not grow with the number of factors and each task sends one
    row per pair.  Dates without a correlation (fewer than two complete pairs,
    a constant side) do not count; a pair without any has none.  NULL and
    non-finite values are missing.
    """
    names = [*new, *kept]
    values = df.select("datetime", "instrument", *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    finite = [F.when(~F.isnan(f"_{i}") & (F.abs(f"_{i}") != float("inf")), F.col(f"_{i}")) for i in range(len(names))]
    centres = [0.0 if m is None else m for m in values.agg(*[F.avg(c) for c in finite]).first()]
    # One small row per DATE, as everywhere in this library.
    days = df.groupBy("datetime").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts")).select("datetime", "_parts", F.xxhash64("datetime").alias("_day"))
    dealt = values.join(F.broadcast(days), "datetime").withColumn("_part", F.pmod(F.xxhash64("instrument"), F.col("_parts")))
    rows = dealt.select("_day", "_part", "_parts", *values.columns[2:]).repartition("_day", "_part").sortWithinPartitions("_day", "_part")
    schema = "day long, i long, j long, " + ", ".join(f"{c} double" for c in (*_SUMS, "corr", "days", "noise_x", "noise_y"))
    cells = rows.mapInArrow(_overlaps(len(new), centres), schema)
    c = F.col
    whole = cells.groupBy("day", "i", "j").agg(*[F.sum(s).alias(s) for s in (*_SUMS, "corr", "days")], F.max("noise_x").alias("noise_x"), F.max("noise_y").alias("noise_y"))
    left, right = c("xx") - c("x") * c("x") / c("n"), c("yy") - c("y") * c("y") / c("n")
    varies = (c("n") > 1) & (left > c("n") * c("noise_x")) & (right > c("n") * c("noise_y"))
    late = F.when(varies, (c("xy") - c("x") * c("y") / c("n")) / F.sqrt(left * right))
    pairs = whole.withColumn("_late", F.when(c("day").isNotNull(), late)).groupBy("i", "j").agg(
        (F.sum("corr") + F.coalesce(F.sum("_late"), F.lit(0.0))).alias("sum"), (F.sum("days") + F.count("_late")).alias("count")
    )
    best = pairs.groupBy("i").agg(F.max(div(F.col("sum"), F.col("count"))).alias("max_corr"))
    return best.select(F.element_at(F.array(*map(F.lit, new)), (F.col("i") + 1).cast("int")).alias("factor"), "max_corr")


def not_redundant(overlap: DataFrame, limit: float = 0.99) -> DataFrame:
    return overlap.where(F.col("max_corr") < limit)


def top_holdings(df: DataFrame, signal: str, k: int = 50) -> DataFrame:
    """The k rows with the largest signal per date; Spark limits each task's
    candidates to k per date before the shuffle."""
    order = Window.partitionBy("datetime").orderBy(F.col(signal).desc(), F.col("instrument"))
    return (
        df.where(F.col(signal).isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )


def portfolio_return(holdings: DataFrame, ret: str) -> DataFrame:
    return holdings.groupBy("datetime").agg(
        F.avg(ret).alias("port_ret"), F.count(F.lit(1)).alias("held")
    )


def turnover_cost(
    holdings: DataFrame, open_cost: float = 0.0005, close_cost: float = 0.0015
) -> DataFrame:
    """Names entering and leaving against the previous date, and their cost
    as a share of an equal-weight book."""
    held = holdings.select("datetime", "instrument").withColumn("_now", F.lit(1))
    calendar = held.select("datetime").distinct().withColumn(
        "_next", F.lead("datetime").over(Window.orderBy("datetime"))
    )
    before = (
        held.join(F.broadcast(calendar), "datetime")
        .where(F.col("_next").isNotNull())
        .select(F.col("_next").alias("datetime"), "instrument", F.lit(1).alias("_before"))
    )
    flows = held.join(before, ["datetime", "instrument"], "full")
    counts = flows.groupBy("datetime").agg(
        F.count("_now").alias("held"),
        F.count_if(F.col("_before").isNull()).alias("entered"),
        F.count_if(F.col("_now").isNull()).alias("left"),
    )
    size = F.greatest(F.col("held"), F.lit(1))
    cost = (F.col("entered") * open_cost + F.col("left") * close_cost) / size
    return counts.withColumn("cost", cost)


def excess_return(report: DataFrame) -> DataFrame:
    """Daily return minus benchmark minus cost, each missing part as zero."""
    value = fill_zero(F.col("port_ret")) - fill_zero(F.col("bench")) - fill_zero(F.col("cost"))
    return report.withColumn("excess", value)


def with_cumulative(report: DataFrame) -> DataFrame:
    """Running sum over the calendar (one row per date, one small window)."""
    return report.withColumn("cumulative", F.sum("excess").over(Window.orderBy("datetime")))


def risk_metrics(report: DataFrame, periods: int = 252, compound: bool = False) -> DataFrame:
    """Annualised return, information ratio, max drawdown, Calmar of ``excess``."""
    days = Window.orderBy("datetime")
    if compound:
        worth = F.product(F.col("excess") + 1).over(days)
    else:
        worth = F.sum("excess").over(days)
    curve = report.withColumn("_worth", worth).withColumn("_peak", F.max("_worth").over(days))
    fall = div(F.col("_worth"), F.col("_peak")) - 1 if compound else F.col("_worth") - F.col("_peak")
    mean, spread, n = F.avg("excess"), F.stddev_samp("excess"), F.count("excess")
    if compound:
        annual = F.pow(F.product(F.col("excess") + 1), F.lit(float(periods)) / n) - 1
    else:
        annual = mean * periods
    return curve.agg(
        annual.alias("annual_return"),
        (div(mean, spread) * F.sqrt(F.lit(float(periods)))).alias("information_ratio"),
        F.min(fall).alias("max_drawdown"),
        div(annual, F.abs(F.min(fall))).alias("calmar"),
    )


# -- benchmark summaries ------------------------------------------------------

def evaluator_table(results: DataFrame, evaluators: Sequence[str]) -> DataFrame:
    """(factor, run, evaluator, metric) to one column per evaluator."""
    return results.groupBy("factor", "run").pivot("evaluator", list(evaluators)).agg(F.max("metric"))


def evaluator_rows(wide: DataFrame, evaluators: Sequence[str]) -> DataFrame:
    """The inverse of ``evaluator_table``."""
    return wide.unpivot(["factor", "run"], list(evaluators), "evaluator", "metric")


def benchmark_summary(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-factor rates with category means and the overall average row.

    ``wide`` has run_error, row_count, index, equal_ratio, correlation per run;
    ``labels`` has factor, category, difficulty (one row per factor).
    """
    fmt = (F.coalesce(F.col("row_count"), F.lit(0.0)) + F.coalesce(F.col("index"), F.lit(0.0))) / 2
    ok = F.when(F.col("run_error"), F.lit(0.0)).otherwise(1.0)
    corr = F.when(fmt == 1.0, F.coalesce(F.col("correlation"), F.lit(0.0)))
    per_factor = wide.groupBy("factor").agg(
        F.avg(ok).alias("run_rate"),
        F.avg(fmt).alias("format_rate"),
        F.avg(corr).alias("avg_corr"),
        F.max(corr).alias("max_corr"),
        F.avg(F.col("equal_ratio") * fmt).alias("avg_accuracy"),
        F.max("equal_ratio").alias("max_accuracy"),
    )
    rates = [c for c in per_factor.columns if c != "factor"]
    named = per_factor.join(labels, "factor", "left")
    level = lambda text: F.lit(text).alias("level")
    factors = named.select(level("factor"), "factor", "category", "difficulty", *rates)
    categories = named.groupBy("category").agg(*[F.avg(c).alias(c) for c in rates]).select(
        level("category"), F.lit("-").alias("factor"), "category", F.lit("-").alias("difficulty"), *rates
    )
    overall = named.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in rates]).select(
        level("average"), F.lit("-").alias("factor"), F.lit("-").alias("category"),
        F.lit("-").alias("difficulty"), *rates,
    )
    return factors.unionByName(categories).unionByName(overall)


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """1 when ones outnumber zeros, else 0."""
    ones, zeros = F.count_if(F.col(vote) == 1), F.count_if(F.col(vote) == 0)
    return votes.groupBy(key).agg(
        ones.alias("ones"), zeros.alias("zeros"), (ones > zeros).cast("int").alias("verdict")
    )


def mean_gap(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, limit: float = 0.1) -> DataFrame:
    """Mean absolute difference of two value tables, and whether it is small."""
    both = a.join(b.withColumnRenamed(value, "_other"), list(keys))
    gap = both.agg(F.avg(F.abs(F.col(value) - F.col("_other"))).alias("mean_gap"))
    return gap.withColumn("passed", F.coalesce(F.col("mean_gap") < limit, F.lit(False)))


def mean_dimension_corr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Average over dimensions of the correlation across rows; inputs (row, dim, value)."""
    both = a.join(b.withColumnRenamed("value", "_other"), ["row", "dim"])
    return both.groupBy("dim").agg(pearson("value", "_other").alias("c")).agg(
        F.avg("c").alias("mean_corr"), F.count("c").alias("dims")
    )
