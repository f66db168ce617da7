"""Elementwise operators.

NULL is the only missing marker.  Sources turn NaN and infinity into NULL, and
every function here that could create one (division, root, power) yields NULL
instead, so ordering and comparison stay free of NaN surprises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def col(x: Column | str | float | int) -> Column:
    """A column by name, a literal number, or the column itself."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def clean(x) -> Column:
    """NaN and infinity become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used several times, or inside a lambda over an array, would be
    evaluated again each time; binding it as a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """``value`` itself, by a function that keeps its projection out of whole-stage code.

    Whole-stage code puts a projection of up to 100 fields into one method, and
    the JVM leaves methods beyond 8,000 bytes of code uncompiled.  One column
    ``apart`` has the projection split into small methods instead.
    """
    return let(value, lambda v: v)


def div(a, b) -> Column:
    """Division whose zero denominator gives NULL."""
    return F.try_divide(col(a), col(b))


def add(a, b) -> Column:
    return col(a) + col(b)


def subtract(a, b) -> Column:
    return col(a) - col(b)


def multiply(a, b) -> Column:
    return col(a) * col(b)


def gt(a, b) -> Column:
    return F.coalesce(col(a) > col(b), F.lit(False))


def lt(a, b) -> Column:
    return F.coalesce(col(a) < col(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(col(a) >= col(b), F.lit(False))


def le(a, b) -> Column:
    return F.coalesce(col(a) <= col(b), F.lit(False))


def eq(a, b) -> Column:
    return F.coalesce(col(a) == col(b), F.lit(False))


def ne(a, b) -> Column:
    """A missing operand differs from everything."""
    return F.coalesce(col(a) != col(b), F.lit(True))


def both(a, b) -> Column:
    return col(a) & col(b)


def either(a, b) -> Column:
    return col(a) | col(b)


def where(cond, a, b) -> Column:
    """``a`` where the condition holds, ``b`` where it fails or is missing."""
    return F.when(col(cond), col(a)).otherwise(col(b))


def keep_if(x, cond) -> Column:
    """Zero where the condition fails; the row stays and NULL stays NULL."""
    return col(x) * col(cond).cast("double")


def absolute(x) -> Column:
    return F.abs(col(x))


def sign(x) -> Column:
    return F.signum(col(x))


def exp(x) -> Column:
    return clean(F.exp(col(x)))


def sqrt(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def log1p(x) -> Column:
    """ln(x + 1), the panel language's LOG."""
    x = col(x)
    return F.when(x > -1, F.log1p(x))


def ln(x) -> Column:
    """ln(x), the LOG of the named factor sets."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def inverse(x) -> Column:
    return div(F.lit(1.0), x)


def power(x, n) -> Column:
    return clean(F.pow(col(x), col(n)))


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def _all_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def larger(*xs) -> Column:
    """Elementwise maximum; one missing argument makes the result missing."""
    cols = [col(x) for x in xs]
    return F.when(_all_present(cols), F.greatest(*cols))


def smaller(*xs) -> Column:
    """Elementwise minimum; one missing argument makes the result missing."""
    cols = [col(x) for x in xs]
    return F.when(_all_present(cols), F.least(*cols))


def fill_zero(x) -> Column:
    return F.coalesce(clean(x), F.lit(0.0))


def rounded(x, digits: int = 8) -> Column:
    """Storage form of a metric: non-finite to NULL, fixed decimals, no -0.0."""
    return F.round(clean(x), digits) + F.lit(0.0)
