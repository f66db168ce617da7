"""Values of factor formulas given as text, such as those of a factor library.

``RANK(TS_MEAN($return, 20)) / ($close - $open)`` is read with the host
language's grammar and becomes Columns: each call is one of the functions of
``functions`` or ``operators``, each operator one of ``functions.basics``.
Calls over a history or a date need their arguments as columns, so they are
laid out by depth.  All calls of one depth are added in one step, and a call
that several formulas share is computed once; a set of formulas costs one
exchange by instrument, as factors written as Columns do.

``&`` and ``|`` are the same as ``&&`` and ``||`` and bind weaker than
comparisons.  Booleans count as 0 and 1 in arithmetic.  A formula that cannot
be read, an unknown function, field or window length is a ``ValueError`` that
names the text, before anything runs.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions import basics
from crosstide.functions import rolling as ts
from crosstide.operators import cross_section, ranking, smoothing
from crosstide.operators.expressions import host_text
from crosstide.sources import stores

#: Inputs whose column has another name.
FIELDS = {"return": "ret"}
#: Formulas whose columns one plan holds.
BATCH = 40

# fixed values: the names of the formula language
ELEMENTWISE: dict[str, Callable[..., Column]] = {
    "ADD": basics.add, "SUBTRACT": basics.subtract, "MULTIPLY": basics.multiply, "DIVIDE": basics.div,
    "GT": basics.gt, "LT": basics.lt, "GE": basics.ge, "LE": basics.le, "EQ": basics.eq, "NE": basics.ne,
    "AND": basics.both, "OR": basics.either, "WHERE": basics.where, "FILTER": basics.keep_if,
    "ABS": basics.absolute, "SIGN": basics.sign, "EXP": basics.exp, "SQRT": basics.sqrt, "LOG": basics.log1p,
    "INV": basics.inverse, "POW": basics.power, "FLOOR": basics.floor, "MAX": basics.larger, "MIN": basics.smaller,
}
ROLLING: dict[str, Callable[..., Column]] = {
    "DELTA": ts.delta, "DELAY": ts.delay, "TS_PCTCHANGE": ts.pct_change, "TS_MEAN": ts.mean, "TS_SUM": ts.total,
    "TS_STD": ts.std, "TS_VAR": ts.var, "TS_MAX": ts.maximum, "TS_MIN": ts.minimum, "TS_MEDIAN": ts.median,
    "TS_QUANTILE": ts.quantile, "PERCENTILE": ts.percentile, "TS_RANK": ts.rank, "TS_ZSCORE": ts.zscore,
    "TS_SKEW": ts.skew, "TS_KURT": ts.kurt, "TS_MAD": ts.mad, "TS_ARGMAX": ts.argmax, "TS_ARGMIN": ts.argmin,
    "HIGHDAY": ts.highday, "LOWDAY": ts.lowday, "COUNT": ts.count_if, "SUMIF": ts.sum_if, "PROD": ts.product,
    "TS_CORR": ts.corr, "TS_COVARIANCE": ts.covariance, "REGBETA": ts.beta, "REGRESI": ts.residual, "WMA": ts.wma,
    "DECAYLINEAR": ts.decay_linear, "BB_MIDDLE": ts.band_middle, "BB_UPPER": ts.band_upper, "BB_LOWER": ts.band_lower,
    "SUMAC": lambda x, p=10: ts.total(x, p),
}
OVER_SEQUENCE: dict[str, Callable[..., Column]] = {
    "TS_CORR": lambda x, n, p=None: ts.corr_time(x, n),
    "TS_COVARIANCE": lambda x, n, p=None: ts.covariance_time(x, n),
    "REGBETA": lambda y, n, p=5: ts.beta(y, None, p),
    "REGRESI": lambda y, n, p=5: ts.residual(y, None, p),
}
STEPS: dict[str, Callable[..., DataFrame]] = {
    "MEAN": cross_section.with_mean, "STD": cross_section.with_std, "SKEW": cross_section.with_skew,
    "KURT": cross_section.with_kurt, "MEDIAN": cross_section.with_median, "ZSCORE": cross_section.with_zscore,
    "SCALE": cross_section.with_scale, "MAX": cross_section.with_max, "MIN": cross_section.with_min,
    "EMA": smoothing.with_ema, "MACD": smoothing.with_macd, "RSI": smoothing.with_rsi,
}
CONSTANTS = {"TRUE": True, "FALSE": False, "NAN": None, "NULL": None, "NONE": None}

_BINARY = {ast.Add: basics.add, ast.Sub: basics.subtract, ast.Mult: basics.multiply, ast.Div: basics.div, ast.Pow: basics.power}
_COMPARE = {ast.Gt: basics.gt, ast.Lt: basics.lt, ast.GtE: basics.ge, ast.LtE: basics.le, ast.Eq: basics.eq, ast.NotEq: basics.ne}
_TRUTHS = {"GT", "LT", "GE", "LE", "EQ", "NE", "AND", "OR"}
_TAKES_TRUTH = {"COUNT": {0}, "SUMIF": {2}, "WHERE": {0}, "FILTER": {1}, "AND": {0, 1}, "OR": {0, 1}}


def tree(text: str) -> ast.expr:
    """The formula's tree."""
    plain = re.sub(r"&&?", " and ", re.sub(r"\|\|?", " or ", re.sub(r"!(?!=)", " not ", text)))
    try:
        return ast.parse(host_text(plain), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ValueError(f"formula cannot be read: {text!r}") from e


def _number(node: ast.expr) -> int | float | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _number(node.operand)
        return None if inner is None else -inner
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    return None


def _called(node: ast.expr) -> str | None:
    """Name of the function that a call names."""
    if not isinstance(node, ast.Call):
        return None
    if not isinstance(node.func, ast.Name) or node.keywords:
        raise ValueError("only plain calls are part of a formula")
    return node.func.id


def _truth(node: ast.expr) -> bool:
    if isinstance(node, ast.Name):
        return isinstance(CONSTANTS.get(node.id.upper()), bool)
    if isinstance(node, ast.IfExp):
        return _truth(node.body) and _truth(node.orelse)
    negated = isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)
    return negated or isinstance(node, (ast.Compare, ast.BoolOp)) or _called(node) in _TRUTHS


@dataclass
class _Reader:
    """Turns trees into Columns; ``placed`` names the columns of calls already laid out."""

    columns: set[str]
    fields: dict[str, str]
    own: dict[str, Callable[..., Column]]
    placed: dict[str, str]

    def staged(self, node: ast.expr) -> bool:
        name = _called(node)
        if name in ("MAX", "MIN") and name not in self.own:
            return len(node.args) == 1
        return name is not None and (name in self.own or name in ROLLING or name in STEPS or name in ("RANK", "SMA"))

    def depth(self, node: ast.AST, found: dict[str, tuple[int, ast.Call]]) -> int:
        """Depth of the calls to lay out below a node, which are added to ``found``."""
        below = max([self.depth(n, found) for n in ast.iter_child_nodes(node)], default=0)
        if isinstance(node, ast.expr) and self.staged(node):
            below += 1
            found[ast.unparse(node)] = (below, node)
        return below

    def field(self, name: str) -> Column:
        if name.upper() in CONSTANTS and not name.startswith("_v_"):
            value = CONSTANTS[name.upper()]
            return F.lit(value).cast("double") if value is None else F.lit(value)
        plain = name.removeprefix("_v_")
        column = self.fields.get(plain, plain)
        if column not in self.columns:
            raise ValueError(f"unknown field {plain!r}")
        return F.col(f"`{column}`").cast("double")

    def value(self, node: ast.expr) -> Column:
        name = _called(node)
        if name is not None:
            if self.staged(node):
                return F.col(self.placed[ast.unparse(node)])
            if name not in ELEMENTWISE:
                raise ValueError(f"unknown function {name!r}")
            return self.call(ELEMENTWISE[name], node)
        number = _number(node)
        if number is not None:
            return F.lit(float(number))
        if isinstance(node, ast.Name):
            return self.field(node.id)
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return ~self.condition(node.operand)
            if isinstance(node.op, (ast.USub, ast.UAdd)):
                inner = self.amount(node.operand)
                return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](self.amount(node.left), self.amount(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](self.amount(node.left), self.amount(node.comparators[0]))
        if isinstance(node, ast.BoolOp):
            join = basics.both if isinstance(node.op, ast.And) else basics.either
            first, *rest = [self.condition(v) for v in node.values]
            for other in rest:
                first = join(first, other)
            return first
        if isinstance(node, ast.IfExp):
            as_truth = _truth(node)
            sides = [self.value(n) if as_truth else self.amount(n) for n in (node.body, node.orelse)]
            return basics.where(self.condition(node.test), *sides)
        raise ValueError(f"not part of the formula language: {ast.unparse(node)!r}")

    def amount(self, node: ast.expr) -> Column:
        value = self.value(node)
        return value.cast("double") if _truth(node) else value

    def condition(self, node: ast.expr) -> Column:
        return self.value(node) if _truth(node) else self.value(node) != 0

    def call(self, fn: Callable[..., Column], node: ast.Call) -> Column:
        """Whole numbers and fractions stay numbers: they are window lengths and quantiles."""
        truths, args = _TAKES_TRUTH.get(node.func.id, set()), []
        for i, arg in enumerate(node.args):
            number = _number(arg)
            args.append(number if number is not None else self.condition(arg) if i in truths else self.amount(arg))
        try:
            return fn(*args)
        except TypeError as e:
            raise ValueError(f"wrong arguments: {ast.unparse(node)!r}") from e

    def window(self, node: ast.Call) -> Column:
        name = node.func.id
        if name in self.own:
            return self.call(self.own[name], node)
        at = [i for i, a in enumerate(node.args) if _called(a) == "SEQUENCE"]
        if name in OVER_SEQUENCE and at:
            length = _number(node.args[at[0]].args[0]) if node.args[at[0]].args else None
            series = [a for i, a in enumerate(node.args[:2]) if i not in at]
            if not isinstance(length, int) or len(series) != 1 or (name.startswith("REG") and at != [1]):
                raise ValueError(f"wrong arguments: {ast.unparse(node)!r}")
            return OVER_SEQUENCE[name](self.amount(series[0]), length, *[_number(a) for a in node.args[2:]])
        return self.call(ROLLING[name] if name != "SMA" else ts.sma, node)

    def step(self, df: DataFrame, out: str, node: ast.Call) -> DataFrame:
        """Add a call that is a step over the table; its argument becomes a column first."""
        name, numbers = node.func.id, [_number(a) for a in node.args[1:]]
        if not node.args or None in numbers:
            raise ValueError(f"wrong arguments: {ast.unparse(node)!r}")
        df = df.withColumn(f"{out}_of", self.amount(node.args[0]))
        if name == "SMA":
            return smoothing.with_ewm(df, {out: smoothing.Ewm(f"{out}_of", alpha=numbers[1] / numbers[0])}).drop(f"{out}_of")
        try:
            return STEPS[name](df, out, f"{out}_of", *numbers).drop(f"{out}_of")
        except TypeError as e:
            raise ValueError(f"wrong arguments: {ast.unparse(node)!r}") from e

    def is_step(self, node: ast.Call) -> bool:
        name = node.func.id
        return name not in self.own and (name in STEPS or (name == "SMA" and len(node.args) == 3))


def with_values(
    panel: DataFrame,
    formulas: dict[str, str],
    fields: dict[str, str] | None = None,
    functions: dict[str, Callable[..., Column]] | None = None,
) -> DataFrame:
    """The panel with a column per formula, NULL where a value is missing.

    ``fields`` names inputs that differ from their columns; ``functions`` adds
    functions of the user's own, Column to Column, which may use windows.
    An empty panel gives an empty one.  Rows of a repeated key have values of
    their own in no defined order; ``panel`` sources drop such rows.
    """
    names = {**FIELDS, **(fields or {})}
    reader = _Reader(set(panel.columns), names, functions or {}, {})
    trees = {name: tree(text) for name, text in formulas.items()}
    found: dict[str, tuple[int, ast.Call]] = {}
    for t in trees.values():
        reader.depth(t, found)
    stem = "_f"
    while any(c.startswith(stem) for c in [*panel.columns, *formulas]):
        stem += "_"
    out = panel
    for level in sorted({d for d, _ in found.values()}):
        here = {text: node for text, (d, node) in found.items() if d == level}
        names_here = {text: f"{stem}{len(reader.placed) + i}" for i, text in enumerate(here)}
        ranked = {text: n for text, n in here.items() if n.func.id == "RANK" and "RANK" not in reader.own}
        steps = {text: n for text, n in here.items() if reader.is_step(n)}
        windows = {names_here[t]: reader.window(n) for t, n in here.items() if t not in ranked and t not in steps}
        out = out.withColumns(windows) if windows else out
        for text, node in steps.items():
            out = reader.step(out, names_here[text], node)
        if ranked:
            if any(len(n.args) != 1 for n in ranked.values()):
                raise ValueError("RANK takes one argument")
            args = {f"{names_here[t]}_of": reader.amount(n.args[0]) for t, n in ranked.items()}
            out = ranking.with_ranks(out.withColumns(args), {names_here[t]: f"{names_here[t]}_of" for t in ranked}).drop(*args)
        reader.placed.update(names_here)
    values = {name: reader.amount(t).cast("double").alias(name) for name, t in trees.items()}
    return out.select(*[F.col(f"`{c}`") for c in panel.columns if c not in values], *values.values())


def fill_store(panel: DataFrame, texts: Iterable[str], path: str, batch: int = BATCH) -> list[str]:
    """Compute the formulas that a value store lacks; returns their texts.

    Only texts reach the driver.  Each plan holds ``batch`` formulas; equal
    texts are computed once.
    """
    wanted, added = list(dict.fromkeys(texts)), []
    for start in range(0, len(wanted), batch):
        part = {f"value_{i}": text for i, text in enumerate(wanted[start: start + batch])}
        with_them = with_values(panel, part)
        added += stores.fill_store(with_them, {text: F.col(name) for name, text in part.items()}, path)
    return added
