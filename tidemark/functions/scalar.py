"""Null-, NaN- and division-safe scalar building blocks.

Policy: a missing value is SQL NULL, and NaN never enters a column.  Division
follows IEEE for a zero denominator with a non-zero numerator (+-inf) and is
NULL for 0/0, so no expression can raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10  # fixed value: guard added to the denominators of ratio features

POS_INF = float("inf")
NEG_INF = float("-inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x: Column | str) -> Column:
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def null_if_inf(x: Column | str) -> Column:
    c = col(x)
    return F.when(F.abs(c) != POS_INF, c)


def fdiv(a: Column | str, b: Column | str) -> Column:
    """a/b with +-inf for x/0 and NULL for 0/0.

    inf/inf is NaN in IEEE arithmetic, hence the final NaN guard.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(a > 0, F.lit(POS_INF)).when(a < 0, F.lit(NEG_INF))
    return F.when(b == 0, zero).otherwise(null_if_nan(F.try_divide(a, b)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / (b + 1e-10): the guarded ratio used by most relative features."""
    return fdiv(a, col(b) + F.lit(EPS))


def flag(condition: Column) -> Column:
    """0/1 flag where an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sign(x: Column | str) -> Column:
    return F.signum(col(x).cast("double"))


def tidy(x: Column | str, digits: int = 6) -> Column:
    """Round for comparison across engines; folds -0.0 into 0.0."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))
