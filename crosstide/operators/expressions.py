"""Analytics over a table of factor expressions."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.basics import div
from crosstide.operators.lookups import lookup
from crosstide.session import cut_lineage

FEATURE = r"\$\w+"

# fixed values: default limits of the acceptance rule
MAX_SHARED, MAX_LENGTH, MAX_FEATURES, MAX_PENALTY = 8, 300, 6, 0.693


def symbol_length(expr: Column) -> Column:
    return F.length(F.trim(expr))


def base_features(expr: Column) -> Column:
    """Number of distinct ``$name`` inputs."""
    return F.size(F.array_distinct(F.regexp_extract_all(expr, F.lit(FEATURE), F.lit(0))))


# -- subtrees -------------------------------------------------------------------

_OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Gt: ">", ast.Lt: "<",
    ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!=", ast.BitAnd: "&",
    ast.BitOr: "|", ast.And: "&&", ast.Or: "||", ast.Pow: "**", ast.Mod: "%",
}
_SIGNS = {ast.USub: "-", ast.UAdd: "+", ast.Not: "!", ast.Invert: "~"}
_COMMUTATIVE = {"+", "*", "==", "!=", "&", "&&", "|", "||"}


def _conditionals(text: str) -> str:
    """``c ? a : b`` in the host language's form, at every bracket depth."""
    depth, marks, out, piece = 0, [], [], ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "(" and depth == 1:
            out.append(piece + "(")
            piece = ""
        elif ch == ")" and depth == 0:
            out.append(",".join(_conditionals(p) for p in _split(piece, ",")) + ")")
            piece = ""
        else:
            piece += ch
    flat = "".join(out) + piece
    parts = _split(flat, "?", 1)
    if len(parts) == 1:
        return flat
    # the matching colon is the first one with no open question mark before it
    depth = pending = 0
    for at, ch in enumerate(parts[1]):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch == "?":
            pending += 1
        elif depth == 0 and ch == ":":
            if pending == 0:
                yes, no = parts[1][:at], parts[1][at + 1:]
                return f"(({_conditionals(yes)}) if ({parts[0]}) else ({_conditionals(no)}))"
            pending -= 1
    raise SyntaxError("conditional without an alternative")


def _split(text: str, mark: str, times: int = -1) -> list[str]:
    """Split at a mark outside brackets."""
    parts, depth, start = [], 0, 0
    for at, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == mark and depth == 0 and len(parts) != times:
            parts.append(text[start:at])
            start = at + 1
    return [*parts, text[start:]]


def host_text(text: str) -> str:
    """An expression in the host language's form; inputs ``$x`` are called ``_v_x``."""
    host = re.sub(r"\$(\w+)", r"_v_\1", text).replace("&&", " and ").replace("||", " or ")
    return _conditionals(host).strip()


def subtrees(text: str) -> list[tuple[str, str, int]]:
    """(canonical text, kind, node count) of every subtree; empty when malformed."""
    found: list[tuple[str, str, int]] = []

    def keep(name: str, kind: str, size: int) -> tuple[str, int]:
        found.append((name, kind, size))
        return name, size

    def operation(op: str, left: tuple[str, int], right: tuple[str, int]) -> tuple[str, int]:
        names = [left[0], right[0]]
        if op in _COMMUTATIVE:
            names.sort()
        return keep(f"({names[0]}{op}{names[1]})", "op", 1 + left[1] + right[1])

    def walk(node: ast.AST) -> tuple[str, int]:
        if isinstance(node, ast.Constant):
            return keep(repr(float(node.value)), "num", 1)
        if isinstance(node, ast.Name):
            return keep(node.id.replace("_v_", "$", 1), "var", 1)
        if isinstance(node, ast.Call):
            args = [walk(a) for a in node.args]
            names = ",".join(a[0] for a in args)
            return keep(f"{node.func.id}({names})", "call", 1 + sum(a[1] for a in args))
        if isinstance(node, ast.UnaryOp):
            inner = walk(node.operand)
            return keep(f"({_SIGNS[type(node.op)]}{inner[0]})", "not" if isinstance(node.op, ast.Not) else "op", 1 + inner[1])
        if isinstance(node, ast.BinOp):
            return operation(_OPS[type(node.op)], walk(node.left), walk(node.right))
        if isinstance(node, ast.IfExp):
            parts = [walk(node.test), walk(node.body), walk(node.orelse)]
            return keep("({}?{}:{})".format(*[p[0] for p in parts]), "cond", 1 + sum(p[1] for p in parts))
        chain = node.values if isinstance(node, ast.BoolOp) else [node.left, *node.comparators]
        ops = [node.op] * (len(chain) - 1) if isinstance(node, ast.BoolOp) else node.ops
        result = walk(chain[0])
        for op, item in zip(ops, chain[1:]):
            result = operation(_OPS[type(op)], result, walk(item))
        return result

    try:
        walk(ast.parse(host_text(text), mode="eval").body)
    except (SyntaxError, KeyError, AttributeError, ValueError, RecursionError):
        return []
    return found


@F.udtf(returnType="subtree string, hash string, kind string, size int")
class Subtrees:
    """A row per subtree of one expression."""

    def eval(self, text: str):
        for name, kind, size in subtrees(text or ""):
            yield name, hashlib.md5(name.encode()).hexdigest(), kind, size


def explode_subtrees(
    df: DataFrame, key: str, expr: str, partitions: int | None = None
) -> DataFrame:
    """(key, subtree, hash, kind, size): one row per subtree of each expression.

    A lateral join with ``Subtrees``.  Taking an expression apart costs far
    more than reading it; ``partitions`` spreads a table that comes from a few
    small files.
    """
    texts = df.select(key, F.col(expr).alias("_text"))
    if partitions:
        texts = texts.repartition(partitions, key)
    return texts.lateralJoin(Subtrees(F.col("_text").outer())).drop("_text")


def node_counts(trees: DataFrame, key: str) -> DataFrame:
    """Constants, distinct variables and all nodes per expression."""
    return trees.groupBy(key).agg(
        F.count_if(F.col("kind") == "num").alias("constants"),
        F.count_distinct(F.when(F.col("kind") == "var", F.col("subtree"))).alias("variables"),
        F.count(F.lit(1)).alias("nodes"),
    )


def largest_shared(new: DataFrame, zoo: DataFrame, key: str) -> DataFrame:
    """(key, shared_size, shared, zoo_key): the largest subtree of each new
    expression that occurs in some other expression of the zoo.

    Inputs are subtree tables.  The zoo is reduced to two holders per hash (the
    first and the second key), enough to answer "held by someone else" for any
    key, so no pair of expressions is ever formed.
    """
    order = Window.partitionBy("hash").orderBy(key)
    two = (
        zoo.select("hash", key)
        .distinct()
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= 2)
    )
    table = cut_lineage(
        two.groupBy("hash").agg(
            F.min(key).alias("_first"), F.max(F.when(F.col("_place") == 2, F.col(key))).alias("_second")
        )
    )
    own = new.groupBy(key, "hash").agg(F.max("size").alias("size"), F.max("subtree").alias("subtree"))
    other = F.when(F.col("_first") != F.col(key), F.col("_first")).otherwise(F.col("_second"))
    hits = lookup(own, table, ["hash"], [key], "inner").withColumn("_other", other)
    best = hits.where(F.col("_other").isNotNull()).groupBy(key).agg(
        F.max_by(
            F.struct("size", "subtree", "_other"), F.struct("size", "subtree")
        ).alias("_best")
    )
    return best.select(
        key,
        F.col("_best.size").alias("shared_size"),
        F.col("_best.subtree").alias("shared"),
        F.col("_best._other").alias("zoo_key"),
    )


def with_acceptance(
    df: DataFrame,
    max_shared: int = MAX_SHARED,
    max_length: int = MAX_LENGTH,
    max_features: int = MAX_FEATURES,
    max_penalty: float = MAX_PENALTY,
) -> DataFrame:
    """Add ``accepted`` and the failed ``reasons``.

    Needs shared_size, constants, variables, nodes, length and features.  A
    row with a false or NULL ``parsed`` is rejected as unparsable, if the
    column is there; it has no nodes to count.
    """
    parsed = F.coalesce(F.col("parsed"), F.lit(False)) if "parsed" in df.columns else F.lit(True)

    def too_much(count: str) -> Column:
        ratio = div(F.col(count).cast("double"), F.col("nodes").cast("double"))
        penalty = F.when(ratio < 1, -F.log(1 - ratio))
        return parsed & F.coalesce(penalty >= max_penalty, F.lit(True))

    failed = {
        "unparsable": ~parsed,
        "shared": F.coalesce(F.col("shared_size"), F.lit(0)) > max_shared,
        "constants": too_much("constants"),
        "variables": too_much("variables"),
        "length": F.col("length") > max_length,
        "features": F.col("features") > max_features,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]))
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


# -- names ----------------------------------------------------------------------

def drop_known_names(new: DataFrame, known: DataFrame, name: str, spread: Sequence[str]) -> DataFrame:
    """New factors whose name no earlier experiment used."""
    return lookup(new, known.select(name).distinct(), [name], spread, "left_anti")


def keep_longest(df: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """One row per name, the longest text, the first on ties."""
    best = df.groupBy(name).agg(
        F.max_by(F.struct(*[c for c in df.columns if c != name]), F.struct(F.length(text), -F.col(order))).alias("_b")
    )
    return best.select(name, "_b.*").select(*df.columns)


def dedup_names(df: DataFrame, replaced: DataFrame, name: str, viable: str, order: str) -> DataFrame:
    """Drop replaced and non-viable names, then keep the first of each
    case-insensitive name.  ``replaced`` has one column, the dropped names."""
    left = lookup(df.where(F.col(viable)), replaced.distinct(), [name], [order], "left_anti")
    first = left.groupBy(F.lower(name).alias("_lower")).agg(
        F.min_by(F.struct(*df.columns), order).alias("_f")
    )
    return first.select("_f.*")


# -- compatibility with the named-set language ------------------------------------

# fixed values: operators the named-set language lacks
UNSUPPORTED = [
    "ZSCORE(", "RANK(", "TS_ZSCORE(", "TS_RANK(", "DELAY(", "DELTA(", "DECAYLINEAR(",
    "REGBETA(", "REGRESI(", "SEQUENCE(", "SUMIF(", "COUNTIF(", "FILTER(", "POW(", "SIGN(",
    "INV(", "RSI(", "MACD(", "BB_", "EMA(", "WMA(", "SMA(", "TS_CORR(", "TS_COVARIANCE(",
    "TS_MAD(", "TS_QUANTILE(", "TS_PCTCHANGE(", "HIGHDAY(", "LOWDAY(", "SUMAC(",
    "TS_ARGMAX(", "TS_ARGMIN(", "?", ":",
]
# fixed values: operator renames, applied in this order
RENAMES = [
    ("TS_MEAN", "Mean"), ("TS_STD", "Std"), ("TS_VAR", "Var"), ("TS_MAX", "Max"),
    ("TS_MIN", "Min"), ("TS_SUM", "Sum"), ("$return", "($close/Ref($close,1)-1)"),
]


def set_language_form(expr: Column) -> Column:
    """The expression in the named-set language, NULL when it has no such form."""
    out = expr
    for old, new in RENAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    pattern = "|".join(re.escape(token) for token in UNSUPPORTED)
    return F.when(~F.upper(out).rlike(pattern), out)
