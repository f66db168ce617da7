"""Rolling values over several window lengths, each from a shorter one.

A moving frame of w rows visits w rows per output row.  When a set needs the
same values over 5, 10, 20, 30 and 60 rows, only the shortest frame has to: the
last 10 rows are the last 5 and the 5 before them, so their state is the state
of this row merged with the state five rows back, which is a ``lag``.  Every
longer window follows the same way, and all layers share one partitioning and
order.  A window's states travel as one struct, windows that can be built at the
same time share a layer, and what is read of a window only is computed as soon
as it stands, so no layer moves more columns than it has to.

States merge without subtraction, so nothing cancels: sums add, extremes
compare, and centred moments combine by counts and means.  A frame whose
extremes are equal is constant and has exactly zero spread.

Quantiles, ranks and deviations from the median read the frame's values in
order.  Their state grows with the window, so it is not carried from layer to
layer: all windows share the ordered blocks of the last five rows, lagged by
five, ten and so on in the first layer, and merge as many as they cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from crosstide.functions.basics import apart, div
from crosstide.functions.rolling import delay, in_order, last_rows, quantile_of, sorted_mad, sorted_rank

SHORTEST = 5
# window: (shorter window, how many of them in a row)
STEPS = {10: (5, 2), 15: (5, 3), 20: (10, 2), 30: (10, 3), 40: (20, 2), 60: (30, 2), 120: (60, 2)}
# the key of what reads values in order, where others have their window
ORDERS = 0


@dataclass(frozen=True)
class Ladder:
    """What to keep per window: columns are named by the input columns."""

    sums: tuple[str, ...] = ()
    maxima: tuple[str, ...] = ()
    minima: tuple[str, ...] = ()
    moments: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    orders: tuple[str, ...] = ()

    def merge(self, other: Ladder) -> Ladder:
        both = lambda a, b: tuple(dict.fromkeys([*a, *b]))
        return Ladder(
            both(self.sums, other.sums),
            both(self.maxima, other.maxima),
            both(self.minima, other.minima),
            both(self.moments, other.moments),
            both(self.pairs, other.pairs),
            both(self.orders, other.orders),
        )


Parts = Callable[[str], list[Column]]  # a state's columns in the windows to merge
Whole = Callable[[str], Column]  # a state's column in the merged window


@dataclass(frozen=True)
class _State:
    """One column per window: its value in a frame, and in a union of frames.

    ``spread`` is set instead of ``merge`` where the union's means come first.
    """

    name: str
    read: Callable[[WindowSpec], Column]
    merge: Callable[[Parts], Column] | None = None
    spread: Callable[[Parts, Whole], Column] | None = None


def _sum(parts: list[Column]) -> Column:
    """Sum of the parts present, NULL when none is."""
    return reduce(lambda a, b: F.coalesce(a + b, a, b), parts)


def _mean(of: Parts, n: str, m: str) -> Column:
    weighted = _sum([w * x for w, x in zip(of(n), of(m))])
    return div(weighted, _sum(of(n)))


def _spread(of: Parts, whole: Whole, n: str, a: str, b: str, q: str) -> Column:
    """Centred (co)moment of the union: inside the parts and between their means."""
    between = [w * (x - whole(a)) * (y - whole(b)) for w, x, y in zip(of(n), of(a), of(b))]
    return _sum(of(q)) + _sum(between)


def _extreme(name: str, value: Column, largest: bool) -> _State:
    read, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    return _State(name, lambda frame: read(value).over(frame), lambda of: pick(*of(name)))


def _moment(x: str, value: Column, counted: str | None = None) -> list[_State]:
    """``counted`` names a state with the same count, if there is one."""
    n, m, q = counted or f"{x}_n", f"{x}_m", f"{x}_q"
    count = _State(n, lambda frame: F.count(value).over(frame).cast("double"), lambda of: _sum(of(n)))
    return [
        *([] if counted else [count]),
        _State(m, lambda frame: F.avg(value).over(frame), lambda of: _mean(of, n, m)),
        _State(
            q,
            lambda frame: F.var_pop(value).over(frame) * F.count(value).over(frame),
            spread=lambda of, whole: _spread(of, whole, n, m, m, q),
        ),
        _extreme(f"{x}_top", value, True),
        _extreme(f"{x}_bottom", value, False),
    ]


def _pair(x: str, y: str) -> list[_State]:
    px = F.when(F.col(y).isNotNull(), F.col(x).cast("double"))
    py = F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
    left, right, c = f"{x}_with_{y}", f"{y}_by_{x}", f"{x}_c_{y}"
    cross = _State(
        c,
        lambda frame: F.covar_pop(px, py).over(frame) * F.count(px).over(frame),
        spread=lambda of, whole: _spread(of, whole, f"{left}_n", f"{left}_m", f"{right}_m", c),
    )
    return [*_moment(left, px), *_moment(right, py, f"{left}_n"), cross]


def _states(spec: Ladder) -> list[_State]:
    out: list[_State] = []
    for x in spec.sums:
        name = f"{x}_s"
        out.append(
            _State(name, lambda frame, x=x: F.sum(x).over(frame), lambda of, name=name: _sum(of(name)))
        )
    out += [_extreme(f"{x}_hi", F.col(x), True) for x in spec.maxima]
    out += [_extreme(f"{x}_lo", F.col(x), False) for x in spec.minima]
    for x in spec.moments:
        out += _moment(x, F.col(x))
    for x, y in spec.pairs:
        out += _pair(x, y)
    return out


def _needed(rungs: Mapping[int, Ladder]) -> dict[int, list[_State]]:
    """The states of every window, those that longer windows are built from included."""
    states = {w: {s.name: s for s in _states(spec)} for w, spec in rungs.items()}
    for w in sorted(STEPS, reverse=True):
        if states.get(w):
            shorter = STEPS[w][0]
            states[shorter] = {**states.get(shorter, {}), **states[w]}
    return {w: list(named.values()) for w, named in states.items() if named}


def _blocks(orders: Mapping[str, set[int]]) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Columns for values in order: over frames, their lags, and every window's values merged from those."""
    frames, back, merged = {}, {}, {}
    for x, windows in orders.items():
        whole = sorted(w for w in windows if w % SHORTEST == 0)
        frames.update({f"_{x}_v{w}": in_order(F.col(x), w) for w in windows - set(whole)})
        if not whole:
            continue
        frames[f"_{x}_block"] = in_order(F.col(x), SHORTEST)
        older = range(1, max(whole) // SHORTEST)
        back.update({f"_{x}_block{i}": delay(f"_{x}_block", SHORTEST * i) for i in older})
        newest = F.col(f"_{x}_block")
        for w in whole:
            # before the history's start there is no block
            blocks = [F.coalesce(f"_{x}_block{i}", F.slice(newest, 1, 0)) for i in older[: w // SHORTEST - 1]]
            merged[f"_{x}_v{w}"] = F.sort_array(F.concat(newest, *blocks)) if blocks else newest
    return frames, back, merged


def climb(df: DataFrame, spec: Ladder, windows: Iterable[int]) -> DataFrame:
    """Add the state columns of every window; read them with the functions below."""
    return climb_rungs(df, dict.fromkeys(windows, spec))


def climb_rungs(
    df: DataFrame,
    rungs: Mapping[int, Ladder],
    ready: Mapping[int, Mapping[str, Column]] | None = None,
    beside: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``climb`` with states of their own for each window.

    ``ready`` holds, by window, columns that read this window alone (by
    ``ORDERS``, columns that read values in order); each comes back as a field
    of the struct ``_f<window>``.  ``beside`` are window columns to add with the
    shortest frame.
    """
    ready, needed = ready or {}, _needed(rungs)
    orders: dict[str, set[int]] = {}
    for w, spec in rungs.items():
        for x in spec.orders:
            orders.setdefault(x, set()).add(w)
    frames, waiting, merged_orders = _blocks(orders)
    direct = sorted(w for w in needed if w not in STEPS)  # no shorter window to build on
    first = {f"_{s.name}{w}": s.read(last_rows(w)) for w in direct for s in needed[w]}
    df = _packed(_added(df, {**(beside or {}), **first, **frames}), direct, needed, ready)
    done = set(direct)
    while waiting or done < needed.keys():
        batch = sorted(w for w in needed.keys() - done if STEPS[w][0] in done)
        parts = {w: [f"_w{STEPS[w][0]}", *_lags(w)] for w in batch}
        back = {name: delay(f"_w{STEPS[w][0]}", p) for w in batch for name, p in _lags(w).items()}
        df = _added(df, {**back, **waiting})
        if waiting:
            df = _ordered(df, merged_orders, ready).drop(*waiting)
            waiting, merged_orders = {}, {}
        merged, spread = {}, {}
        for w in batch:
            of = lambda name, w=w: [F.col(part)[name] for part in parts[w]]
            whole = lambda name, w=w: F.col(f"_{name}{w}")
            merged.update({f"_{s.name}{w}": s.merge(of) for s in needed[w] if s.merge})
            spread.update({f"_{s.name}{w}": s.spread(of, whole) for s in needed[w] if s.spread})
        if merged:
            same = next(iter(merged))
            merged[same] = apart(merged[same])
            spread[same] = apart(F.col(same))
        df = _packed(_added(_added(df, merged), spread).drop(*back), batch, needed, ready)
        done.update(batch)
    df = _ordered(df, merged_orders, ready) if orders and merged_orders else df
    df = df.drop(*[f"_{x}_block" for x in orders])
    states = {f"_{s.name}{w}": F.col(f"_w{w}")[s.name] for w in needed for s in needed[w]}
    return _added(df, states).drop(*[f"_w{w}" for w in needed])


def _added(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns)) if columns else df


def _lags(w: int) -> dict[str, int]:
    """Names and distances of the older parts that a window is built from."""
    shorter, copies = STEPS[w]
    return {f"_w{shorter}_back{shorter * i}": shorter * i for i in range(1, copies)}


def _ordered(df: DataFrame, merged: Mapping[str, Column], ready: Mapping[int, Mapping[str, Column]]) -> DataFrame:
    df = _added(df, merged)
    return _added(df, _fields(ready, ORDERS))


def _fields(ready: Mapping[int, Mapping[str, Column]], w: int) -> dict[str, Column]:
    return {f"_f{w}": F.struct(*[c.alias(k) for k, c in ready[w].items()])} if ready.get(w) else {}


def _packed(
    df: DataFrame, windows: list[int], needed: Mapping[int, list[_State]], ready: Mapping[int, Mapping[str, Column]]
) -> DataFrame:
    """Each window's states as one struct, and what reads them."""
    packs: dict[str, Column] = {}
    for w in windows:
        first, *rest = [s.name for s in needed[w]]
        packs[f"_w{w}"] = F.struct(apart(_c(first, w)).alias(first), *[_c(name, w).alias(name) for name in rest])
        packs.update(_fields(ready, w))
    return _added(df, packs).drop(*[f"_{s.name}{w}" for w in windows for s in needed[w]])


# -- reading a window's values ------------------------------------------------------

def _c(name: str, w: int) -> Column:
    return F.col(f"_{name}{w}")


def total(x: str, w: int) -> Column:
    return _c(f"{x}_s", w)


def maximum(x: str, w: int) -> Column:
    return _c(f"{x}_hi", w)


def minimum(x: str, w: int) -> Column:
    return _c(f"{x}_lo", w)


def mean(x: str, w: int) -> Column:
    return _c(f"{x}_m", w)


def _square(x: str, w: int) -> Column:
    """Sum of squared deviations, exactly zero for a constant frame."""
    return F.when(_c(f"{x}_top", w) == _c(f"{x}_bottom", w), F.lit(0.0)).otherwise(_c(f"{x}_q", w))


def std(x: str, w: int) -> Column:
    n = _c(f"{x}_n", w)
    return F.when(n > 1, F.sqrt(_square(x, w) / (n - 1)))


def corr(x: str, y: str, w: int) -> Column:
    squares = _square(f"{x}_with_{y}", w) * _square(f"{y}_by_{x}", w)
    return div(_c(f"{x}_c_{y}", w), F.sqrt(squares))


def slope(x: str, y: str, w: int) -> Column:
    """Slope of x on y."""
    return div(_c(f"{x}_c_{y}", w), _square(f"{y}_by_{x}", w))


def fitted(x: str, y: str, w: int) -> Column:
    """Value of x's line on y at the current row."""
    centre = F.col(y) - _c(f"{y}_by_{x}_m", w)
    return _c(f"{x}_with_{y}_m", w) + slope(x, y, w) * centre


def quantile(x: str, w: int, q: float) -> Column:
    return quantile_of(_c(f"{x}_v", w), q)


def median(x: str, w: int) -> Column:
    return quantile(x, w, 0.5)


def rank(x: str, w: int) -> Column:
    """Average-tie percent rank of the current value inside its frame."""
    return sorted_rank(_c(f"{x}_v", w), F.col(x))


def mad(x: str, w: int) -> Column:
    """Median absolute deviation from the frame's median."""
    return sorted_mad(_c(f"{x}_v", w))
