"""Named factor sets.

Spark evaluates equal window expressions of one projection separately, and the
families share most of theirs.  A set is therefore laid out in layers: shifted
values, inputs made of them, then each distinct rolling value once (long windows
from shorter ones, see ``functions.ladder``), then window-free formulas, which
follow at once where they read one window only.  All layers use the same
partitioning and order, so a set costs one shuffle and one sort per instrument.  The formulas (names, windows, the 1e-12 guards) are fixed
values of the sets.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions import ladder
from crosstide.functions import rolling as ts
from crosstide.functions.basics import absolute, div, larger, ln, smaller
from crosstide.functions.ladder import Ladder

WINDOWS = (5, 10, 20, 30, 60)
TINY = 1e-12

O, H, L, C, V, VWAP = "open", "high", "low", "close", "volume", "vwap"


@dataclass
class FactorSet:
    """Named factors over helper layers; later names replace earlier ones.

    ``rungs`` are the rolling values kept by window; ``at`` names the window of
    a factor that reads no other one, or ``ladder.ORDERS``.
    """

    factors: dict[str, Column]
    inputs: dict[str, Column] = field(default_factory=dict)
    rolled: dict[str, Column] = field(default_factory=dict)
    rungs: dict[int, Ladder] = field(default_factory=dict)
    at: dict[str, int] = field(default_factory=dict)
    shifts: dict[str, Column] = field(default_factory=dict)

    def merge(self, other: FactorSet) -> FactorSet:
        rungs = dict(self.rungs)
        for w, spec in other.rungs.items():
            rungs[w] = rungs[w].merge(spec) if w in rungs else spec
        kept = {k: w for k, w in self.at.items() if k not in other.factors}
        return FactorSet(
            {**self.factors, **other.factors},
            {**self.inputs, **other.inputs},
            {**self.rolled, **other.rolled},
            rungs,
            {**kept, **other.at},
            {**self.shifts, **other.shifts},
        )


def candle_shapes(full: bool = True) -> dict[str, Column]:
    """Shapes of a single bar, relative to open and to its own range."""
    c = F.col
    span = c(H) - c(L) + TINY
    top, bottom = larger(O, C), smaller(O, C)
    shift = 2 * c(C) - c(H) - c(L)
    out = {
        "KMID": div(c(C) - c(O), O),
        "KLEN": div(c(H) - c(L), O),
        "KMID2": div(c(C) - c(O), span),
        "KUP": div(c(H) - top, O),
        "KUP2": div(c(H) - top, span),
        "KLOW": div(bottom - c(L), O),
        "KLOW2": div(bottom - c(L), span),
        "KSFT": div(shift, O),
        "KSFT2": div(shift, span),
    }
    if not full:
        out = {k: out[k] for k in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")}
    return out


PRICE_LADDER = Ladder(maxima=(H,), minima=(L,), moments=(C, V), pairs=((C, "_lv"),))
FULL_LADDER = PRICE_LADDER.merge(
    Ladder(
        sums=("_up", "_down", "_vup", "_vdown", "_rise", "_fall", "_seen"),
        maxima=("_first_top",),
        minima=("_first_bottom",),
        moments=("_turb",),
        pairs=((C, "_t"), ("_change", "_vchange")),
        orders=(C,),
    )
)


def _price_factors(w: int) -> dict[str, Column]:
    c = F.col
    low, high = ladder.minimum(L, w), ladder.maximum(H, w)
    return {
        f"ROC{w}": div(f"_ref{w}", C),
        f"MA{w}": div(ladder.mean(C, w), C),
        f"STD{w}": div(ladder.std(C, w), C),
        f"MAX{w}": div(high, C),
        f"MIN{w}": div(low, C),
        f"RSV{w}": div(c(C) - low, high - low + TINY),
        f"VMA{w}": div(ladder.mean(V, w), c(V) + TINY),
        f"VSTD{w}": div(ladder.std(V, w), c(V) + TINY),
        f"CORR{w}": ladder.corr(C, "_lv", w),
    }


def _price_inputs() -> dict[str, Column]:
    return {"_lv": ln(F.col(V) + 1)}


def price_families(w: int) -> FactorSet:
    """The nine price and volume families of the compact set."""
    factors = _price_factors(w)
    return FactorSet(
        factors, _price_inputs(), {f"_ref{w}": ts.delay(C, w)}, {w: PRICE_LADDER}, dict.fromkeys(factors, w)
    )


def plain_families(w: int) -> FactorSet:
    """ROC, MA and STD alone, at any window length."""
    values = {f"ROC{w}": f"_ref{w}", f"MA{w}": ladder.mean(C, w), f"STD{w}": ladder.std(C, w)}
    factors = {k: div(v, C) for k, v in values.items()}
    return FactorSet(
        factors, {}, {f"_ref{w}": ts.delay(C, w)}, {w: Ladder(moments=(C,))}, dict.fromkeys(factors, w)
    )


def _shifts() -> dict[str, Column]:
    return {"_t": ts.position(), "_close1": ts.delay(C, 1), "_volume1": ts.delay(V, 1)}


def _inputs() -> dict[str, Column]:
    """Inputs made of a row and its ``_shifts``."""
    dc, dv, zero = F.col(C) - F.col("_close1"), F.col(V) - F.col("_volume1"), F.lit(0.0)
    change = div(C, "_close1")
    at, high, low = F.col("_t"), F.col(H), F.col(L)
    return {
        **_price_inputs(),
        "_rise": (dc > 0).cast("int"),
        "_fall": (dc < 0).cast("int"),
        "_seen": dc.isNotNull().cast("int"),
        "_up": larger(dc, zero),
        "_down": larger(-dc, zero),
        "_vup": larger(dv, zero),
        "_vdown": larger(-dv, zero),
        "_change": change,
        "_vchange": ln(div(V, "_volume1") + 1),
        "_turb": absolute(change - 1) * F.col(V),
        # value and place together, so the oldest extreme wins a tie
        "_first_top": F.when(high.isNotNull(), F.struct(high.alias("v"), (-at).alias("t"))),
        "_first_bottom": F.when(low.isNotNull(), F.struct(low.alias("v"), at.alias("t"))),
    }


def _shares(up: str, down: str, w: int, stem: str) -> dict[str, Column]:
    """Share of total movement going up, going down, and their difference."""
    ups, downs = ladder.total(up, w), ladder.total(down, w)
    moved = ups + downs + TINY
    return {
        f"{stem}P{w}": div(ups, moved),
        f"{stem}N{w}": div(downs, moved),
        f"{stem}D{w}": div(ups - downs, moved),
    }


def window_families(w: int) -> FactorSet:
    """All 29 windowed families at one window length."""
    oldest = F.greatest(F.col("_t") - (w - 1), F.lit(1))
    hi = -ladder.maximum("_first_top", w)["t"] - oldest + 1
    lo = ladder.minimum("_first_bottom", w)["t"] - oldest + 1
    rises, falls = (div(ladder.total(x, w), ladder.total("_seen", w)) for x in ("_rise", "_fall"))
    r = ladder.corr(C, "_t", w)
    factors = {
        **_price_factors(w),
        f"BETA{w}": div(ladder.slope(C, "_t", w), C),
        f"RSQR{w}": r * r,
        f"RESI{w}": div(F.col(C) - ladder.fitted(C, "_t", w), C),
        f"QTLU{w}": div(ladder.quantile(C, w, 0.8), C),
        f"QTLD{w}": div(ladder.quantile(C, w, 0.2), C),
        f"RANK{w}": ladder.rank(C, w),
        f"IMAX{w}": hi / w,
        f"IMIN{w}": lo / w,
        f"IMXD{w}": (hi - lo) / w,
        f"CORD{w}": ladder.corr("_change", "_vchange", w),
        f"CNTP{w}": rises,
        f"CNTN{w}": falls,
        f"CNTD{w}": rises - falls,
        **_shares("_up", "_down", w, "SUM"),
        f"WVMA{w}": div(ladder.std("_turb", w), ladder.mean("_turb", w) + TINY),
        **_shares("_vup", "_vdown", w, "VSUM"),
    }
    at = {**dict.fromkeys(factors, w), **dict.fromkeys((f"QTLU{w}", f"QTLD{w}", f"RANK{w}"), ladder.ORDERS)}
    return FactorSet(factors, _inputs(), {f"_ref{w}": ts.delay(C, w)}, {w: FULL_LADDER}, at, _shifts())


def set_158() -> FactorSet:
    """158 factors: 9 bar shapes, 4 price ratios, 29 families by 5 windows."""
    ratios = {f"{x.upper()}0": div(x, C) for x in (O, H, L, VWAP)}
    out = FactorSet({**candle_shapes(), **ratios})
    for w in WINDOWS:
        out = out.merge(window_families(w))
    return out


def set_158_20() -> FactorSet:
    """The 20-factor selection; its ROC, RSV and VRATIO forms are its own."""
    c = F.col
    factors = {"ROC0": div(c(C) - c(O), O), "ROC1": c("_ret")}
    for w in (5, 10, 20):
        factors[f"ROC{w}"] = div(c(C) - c(f"_ref{w}"), f"_ref{w}")
    for w in (5, 10):
        factors[f"VRATIO{w}"] = div(V, ladder.mean(V, w))
        factors[f"VOLATILITY{w}"] = div(ladder.std(C, w), C)
        factors[f"RSV{w}"] = _price_factors(w)[f"RSV{w}"]
    factors.update(
        {
            "VSTD5_RATIO": div(ladder.std(V, 5), ladder.mean(V, 5)),
            "RANGE": div(c(H) - c(L), O),
            "RET_VOL5": c("_rsd5"),
            "HIGH_RATIO5": div(C, ladder.maximum(H, 5)) - 1,
            "LOW_RATIO5": div(C, ladder.minimum(L, 5)) - 1,
            "SHADOW_RATIO": div(c(H) - c(C), c(C) - c(L) + TINY),
            "BODY_RATIO": div(c(C) - c(O), c(H) - c(L) + TINY),
            "MA_RATIO5_10": div(ladder.mean(C, 5), ladder.mean(C, 10)) - 1,
            "MA_RATIO10_20": div(ladder.mean(C, 10), "_ma20") - 1,
        }
    )
    rolled = {f"_ref{w}": ts.delay(C, w) for w in (5, 10, 20)}
    rolled.update({"_ma20": ts.mean(C, 20), "_rsd5": ts.std("_ret", 5)})
    return FactorSet(
        factors,
        {"_ret": div(C, ts.delay(C, 1)) - 1},
        rolled,
        dict.fromkeys((5, 10), Ladder(maxima=(H,), minima=(L,), moments=(C, V))),
    )


def set_360() -> FactorSet:
    """The 66-factor price and volume set."""
    out = FactorSet({})
    for w in WINDOWS:
        out = out.merge(price_families(w))
    for w in (3, 7, 15, 40, 120):
        out = out.merge(plain_families(w))
    return out.merge(FactorSet(candle_shapes(full=False)))


def baseline_4() -> FactorSet:
    c = F.col
    return FactorSet(
        {
            "OPEN_RET": div(c(C) - c(O), O),
            "VOL_RATIO": div(V, "_vma20"),
            "RANGE_RET": div(c(H) - c(L), "_prev"),
            "CLOSE_RET": div(C, "_prev") - 1,
        },
        {"_prev": ts.delay(C, 1), "_vma20": ts.mean(V, 20)},
    )


def label() -> Column:
    """Return from the next row's close to the one after; looks ahead."""
    return div(ts.ahead(C, 2), ts.ahead(C, 1)) - 1


SETS = {"alpha158": set_158, "alpha158_20": set_158_20, "alpha360": set_360}


def factor_set(
    source: str, custom: FactorSet | None = None, official: str = "alpha158_20"
) -> FactorSet:
    """A factor source by name; in ``combined`` the custom names win."""
    if source in SETS:
        return SETS[source]()
    if source == "custom":
        return custom or FactorSet({})
    if source == "combined":
        return SETS[official]().merge(custom or FactorSet({}))
    raise ValueError(f"unknown factor source {source!r}")


def factor_matrix(panel: DataFrame, factors: FactorSet, keep: Iterable[str] = ()) -> DataFrame:
    """Key, kept and factor columns of a panel."""
    layered = panel.withColumns(factors.shifts) if factors.shifts else panel
    layered = layered.withColumns(factors.inputs) if factors.inputs else layered
    ready: dict[int, dict[str, Column]] = {}
    for k, w in factors.at.items():
        ready.setdefault(w, {})[k] = factors.factors[k]
    layered = ladder.climb_rungs(layered, factors.rungs, ready, factors.rolled)
    early = {k: F.col(f"_f{w}").getField(k) for k, w in factors.at.items()}
    return layered.select(
        "datetime", "instrument", *keep, *[early.get(k, v).alias(k) for k, v in factors.factors.items()]
    )
