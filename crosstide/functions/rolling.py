"""Time-series operators: Column to Column over one instrument's history.

Frames count rows, as the panel language does, so a gap in the calendar is not
a skipped day.  All functions share the same partitioning and ordering, so any
number of them in one ``select`` costs a single shuffle on ``instrument``.

The partition of such a window is one instrument's history.  A panel has one
row per (datetime, instrument) with DATE-typed datetime, so that history is at
most one row per calendar day (about 18 thousand in 70 years of weekdays)
however large the panel grows.  ``sources.panel`` casts to DATE and reduces
copies of a key with a pre-aggregated ``keep_last``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from crosstide.functions.basics import clean, col, div, let



def history() -> WindowSpec:
    """One instrument's rows in date order."""
    return Window.partitionBy("instrument").orderBy("datetime")


def last_rows(p: int) -> WindowSpec:
    """The current row and the ``p - 1`` rows before it."""
    if p < 1:
        raise ValueError("window must cover at least one row")
    return history().rowsBetween(-(p - 1), Window.currentRow)


def position() -> Column:
    """Row number of the instrument's history, from 1."""
    return F.row_number().over(history())


def _full(x: Column, frame: WindowSpec) -> Column:
    """True when no value of the frame is missing."""
    return F.count(x).over(frame) == F.count(F.lit(1)).over(frame)


# -- shifts -----------------------------------------------------------------

def delay(x, p: int = 1) -> Column:
    if p < 0:
        raise ValueError("delay must not look ahead")
    return F.lag(col(x), p).over(history()) if p else col(x)


def ahead(x, p: int) -> Column:
    """Future value; for labels only, never for factors."""
    return F.lead(col(x), p).over(history())


def delta(x, p: int = 1) -> Column:
    return col(x) - delay(x, p)


def pct_change(x, p: int = 1) -> Column:
    return F.coalesce(div(x, delay(x, p)) - 1, F.lit(0.0))


# -- rolling moments ----------------------------------------------------------

def mean(x, p: int = 5) -> Column:
    return F.avg(col(x)).over(last_rows(p))


def total(x, p: int = 5) -> Column:
    return F.sum(col(x)).over(last_rows(p))


def std(x, p: int = 20) -> Column:
    return F.stddev_samp(col(x)).over(last_rows(p))


def var(x, p: int = 5, ddof: int = 1) -> Column:
    frame = last_rows(p)
    if ddof == 1:
        return F.var_samp(col(x)).over(frame)
    if ddof == 0:
        return F.var_pop(col(x)).over(frame)
    n = F.count(col(x)).over(frame)
    return F.when(n > ddof, div(F.var_pop(col(x)).over(frame) * n, n - ddof))


def maximum(x, p: int = 5) -> Column:
    return F.max(col(x)).over(last_rows(p))


def minimum(x, p: int = 5) -> Column:
    return F.min(col(x)).over(last_rows(p))


def zscore(x, p: int = 5) -> Column:
    return div(col(x) - mean(x, p), std(x, p))


def skew(x, p: int = 5) -> Column:
    """Population skewness, from three values on."""
    frame = last_rows(p)
    return F.when(F.count(col(x)).over(frame) >= 3, clean(F.skewness(col(x)).over(frame)))


def kurt(x, p: int = 5) -> Column:
    """Population excess kurtosis, from four values on."""
    frame = last_rows(p)
    return F.when(F.count(col(x)).over(frame) >= 4, clean(F.kurtosis(col(x)).over(frame)))


def count_if(cond, p: int = 20) -> Column:
    return F.sum(col(cond).cast("int")).over(last_rows(p))


def sum_if(x, p: int, cond) -> Column:
    return F.sum(col(x) * col(cond).cast("double")).over(last_rows(p))


def product(x, p: int | float = 5) -> Column:
    """Rolling product over whole frames; a non-integer ``p`` scales instead."""
    if not isinstance(p, int):
        return col(x) * p
    frame = last_rows(p)
    return F.when(_full(col(x), frame), F.product(col(x)).over(frame))


def share_true(cond, p: int) -> Column:
    """Mean of a comparison, missing comparisons skipped."""
    return F.avg(cond.cast("int")).over(last_rows(p))


# -- order statistics ---------------------------------------------------------

def in_order(x: Column, p: int) -> Column:
    """The frame's values in ascending order, missing ones left out."""
    return F.sort_array(F.collect_list(x).over(last_rows(p)))


def quantile_of(seen: Column, q: float) -> Column:
    """Linear quantile of a stored array in ascending order, NULL for an empty one."""
    at = (F.size(seen) - 1) * F.lit(float(q))
    low, high = F.floor(at), F.ceil(at)
    a, b = F.get(seen, low.cast("int")), F.get(seen, high.cast("int"))
    return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)


def sorted_quantile(values: Column, q: float) -> Column:
    """``quantile_of`` an array that is computed in place, and once."""
    return let(values, lambda seen: quantile_of(seen, q))


def sorted_rank(values: Column, x: Column) -> Column:
    """Average-tie percent rank of ``x`` among values in ascending order, of which it is one."""
    first, last = F.array_position(values, x), F.array_position(F.reverse(values), x)
    n = F.size(values)
    # ties lie between the first place from below and the first from above
    return F.when(x.isNotNull(), (n + first - last + 1) / 2 / n)


def sorted_mad(values: Column) -> Column:
    """Median absolute deviation from the median of values in ascending order."""
    away = lambda centre: F.sort_array(F.transform(values, lambda v: F.abs(v - centre)))
    return let(sorted_quantile(values, 0.5), lambda centre: sorted_quantile(away(centre), 0.5))


def median(x, p: int = 5) -> Column:
    return quantile(x, p, 0.5)


def quantile(x, p=5, q=0.5) -> Column:
    """Linear quantile; the two parameters may come in either order."""
    if isinstance(p, float) and 0 < p < 1 and q > 1:
        p, q = int(q), p
    if not 0 <= q <= 1:
        raise ValueError("quantile must lie in [0, 1]")
    return sorted_quantile(in_order(col(x).cast("double"), int(p)), q)


def percentile(x, q: float, p: int | None = None) -> Column:
    """Rolling quantile, or the whole history's when ``p`` is left out.

    The whole-history form looks ahead and must not enter a trading signal.
    """
    if p is not None:
        return quantile(x, p, q)
    return F.percentile(col(x), q).over(Window.partitionBy("instrument"))


def rank(x, p: int = 5) -> Column:
    """Average-tie percent rank of the current value inside its frame."""
    return let(in_order(col(x), p), lambda values: sorted_rank(values, col(x)))


def mad(x, p: int = 5) -> Column:
    """Median absolute deviation from the frame's median."""
    return let(in_order(col(x), p), sorted_mad)


def _extreme_position(x: Column, p: int, largest: bool) -> Column:
    """History position of the frame's extremum, the oldest one on ties."""
    at = position()
    if largest:
        key = F.when(x.isNotNull(), F.struct(x, -at))
        return F.max_by(at, key).over(last_rows(p))
    key = F.when(x.isNotNull(), F.struct(x, at))
    return F.min_by(at, key).over(last_rows(p))


def argmax(x, p: int = 5) -> Column:
    """Rows since the frame's maximum."""
    return position() - _extreme_position(col(x), p, True)


def argmin(x, p: int = 5) -> Column:
    """Rows since the frame's minimum."""
    return position() - _extreme_position(col(x), p, False)


def highday(x, p: int = 5) -> Column:
    return argmax(x, p) + 1


def lowday(x, p: int = 5) -> Column:
    return argmin(x, p) + 1


def index_of_max(x, p: int) -> Column:
    """1-based position of the maximum inside the frame."""
    return _extreme_position(col(x), p, True) - F.min(position()).over(last_rows(p)) + 1


def index_of_min(x, p: int) -> Column:
    """1-based position of the minimum inside the frame."""
    return _extreme_position(col(x), p, False) - F.min(position()).over(last_rows(p)) + 1


# -- two-series statistics ----------------------------------------------------

def _paired(x, y) -> tuple[Column, Column]:
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def corr(x, y, p: int = 5) -> Column:
    """Pearson correlation over complete pairs, NULL for a constant side."""
    x, y = _paired(x, y)
    frame = last_rows(p)
    return div(
        F.covar_samp(x, y).over(frame),
        F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame),
    )


def corr_time(x, n: int) -> Column:
    """Correlation with 1..n; a constant frame counts as uncorrelated."""
    x = col(x)
    frame = last_rows(n)
    ready = _full(x, frame) & (F.count(x).over(frame) >= 2)
    return F.when(ready, F.coalesce(corr(x, position(), n), F.lit(0.0)))


def covariance(x, y, p: int = 5) -> Column:
    x, y = _paired(x, y)
    frame = last_rows(p)
    return F.covar_samp(x, y).over(frame)


def covariance_time(x, n: int) -> Column:
    x = col(x)
    frame = last_rows(n)
    return F.when(_full(x, frame), covariance(x, position(), n))


def _slope(y: Column, x: Column, frame: WindowSpec) -> Column:
    return div(F.covar_pop(x, y).over(frame), F.var_pop(x).over(frame))


def beta(y, x=None, p: int = 5) -> Column:
    """Slope of y on x over full frames, missing values read as zero.

    ``x=None`` regresses on time.
    """
    y0 = F.coalesce(col(y).cast("double"), F.lit(0.0))
    x0 = position().cast("double") if x is None else F.coalesce(col(x).cast("double"), F.lit(0.0))
    return F.when(position() >= p, _slope(y0, x0, last_rows(p)))


def residual(y, x=None, p: int = 5) -> Column:
    """Residual of the frame's last row under the same regression."""
    y0 = F.coalesce(col(y).cast("double"), F.lit(0.0))
    x0 = position().cast("double") if x is None else F.coalesce(col(x).cast("double"), F.lit(0.0))
    frame = last_rows(p)
    fitted = F.avg(y0).over(frame) + _slope(y0, x0, frame) * (x0 - F.avg(x0).over(frame))
    return F.when(position() >= p, y0 - fitted)


def slope(x, p: int) -> Column:
    """Trend of x against time over the rows present."""
    x, t = _paired(x, position())
    return _slope(x, t, last_rows(p))


def rsquare(x, p: int) -> Column:
    """Squared correlation of x with time."""
    return F.pow(corr(x, position(), p), F.lit(2.0))


def trend_residual(x, p: int) -> Column:
    """Distance of the current value from its own trend line."""
    x, t = _paired(x, position())
    frame = last_rows(p)
    return x - (F.avg(x).over(frame) + _slope(x, t, frame) * (t - F.avg(t).over(frame)))


# -- weighted averages --------------------------------------------------------

def wma(x, p: int = 20) -> Column:
    """Weights 0.9^age, renormalised when the frame is short."""
    x = col(x)
    frame = last_rows(p)
    # Horner form: each step ages what is already summed
    aged = F.aggregate(
        F.collect_list(x).over(frame), F.lit(0.0), lambda acc, v: acc * F.lit(0.9) + v
    )
    n = F.count(x).over(frame)
    weights = (F.lit(1.0) - F.pow(F.lit(0.9), n)) / F.lit(0.1)
    return F.when(_full(x, frame), aged / weights)


def decay_linear(x, p: int = 5) -> Column:
    """Weights 1..p over the sum of all p weights, also on short frames."""
    x = col(x)
    frame = last_rows(p)
    seen = F.collect_list(x).over(frame)
    weighted = F.transform(seen, lambda v, i: v * (i + 1))
    summed = F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(_full(x, frame), summed / F.lit(p * (p + 1) / 2))


def sma(x, m: int, n: int | None = None) -> Column:
    """Plain moving average; with ``n`` use ``smoothing.ewm`` at alpha n/m."""
    if n is not None:
        raise ValueError("the recursive form is smoothing.ewm(alpha=n / m)")
    return mean(x, m)


# -- bands --------------------------------------------------------------------

def band_middle(x, w: int) -> Column:
    return mean(x, w)


def band_upper(x, w: int) -> Column:
    return mean(x, w) + std(x, w)


def band_lower(x, w: int) -> Column:
    return mean(x, w) - std(x, w)


def varying_bands(x, w, widest: int) -> tuple[Column, Column, Column]:
    """(middle, upper, lower) where every row names its own window length.

    Lengths below one count as one.  ``widest`` must bound them; a longer
    length is an error at run time rather than a silently short window.
    """
    x = col(x)
    length = F.greatest(F.floor(col(w)).cast("int"), F.lit(1))
    length = F.when(length <= widest, length).otherwise(
        F.raise_error(F.lit(f"window length above {widest}")).cast("int")
    )
    # struct keeps missing values in place, so a slice counts rows, not values
    seen = F.collect_list(F.struct(x.alias("v"))).over(last_rows(widest))
    tail = F.slice(seen, F.greatest(F.size(seen) - length + 1, F.lit(1)), length)
    present = F.transform(F.filter(tail, lambda s: s["v"].isNotNull()), lambda s: s["v"])

    def moments(values: Column) -> Column:
        n = F.size(values)
        centre = div(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), n)

        def spread(c: Column) -> Column:
            squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - c) * (v - c))
            return F.struct(c.alias("mean"), F.when(n > 1, F.sqrt(div(squares, n - 1))).alias("std"))

        return let(centre, spread)

    stats = let(present, moments)
    centre, std_ = stats["mean"], stats["std"]
    return centre, centre + std_, centre - std_
