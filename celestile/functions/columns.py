"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | float | int


def col(x: Value) -> Column:
    """A name is a column, a number a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x: Value) -> Column:
    """True where x is a finite number; null counts as not."""
    c = col(x).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, also where ``use`` names it within a loop over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded(x: Value, digits: int) -> Column:
    """x to so many decimals as SQL engines round doubles: the product by a power of ten, half away from zero, the sign kept at zero.

    Spark's own round goes by the shortest decimal text, which differs at ties, and loses the sign of zero.
    """
    shift = F.lit(10.0**digits)
    return let(col(x).cast("double") * shift, lambda p: F.when(F.abs(p) == F.lit(float("inf")), col(x)).otherwise(F.signum(p) * F.round(F.abs(p), 0) / shift))
