"""Floating-point Columns with IEEE results.

Field arithmetic keeps going on singular input: ``1/0`` is infinity, ``log(-1)``
is NaN.  Spark in ANSI mode raises on the first and returns NULL on the second,
so the functions here guard the operand instead of the result; all of them stay
ordinary code-generated expressions.  NULL still propagates as NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _zero_sign(b: Column) -> Column:
    """+1 for ``+0.0`` and -1 for ``-0.0`` (which Spark treats as equal)."""
    return F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)


def div(a, b) -> Column:
    a, b = _col(a), _col(b)
    zero = b == 0.0
    safe = a / F.when(zero, 1.0).otherwise(b)
    at_zero = F.when((a == 0.0) | F.isnan(a), NAN).otherwise(F.signum(a) * _zero_sign(b) * INF)
    return F.when(zero, at_zero).otherwise(safe)


def mod(a, b) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    a, b = _col(a), _col(b)
    zero = b == 0.0
    rem = a % F.when(zero, 1.0).otherwise(b)
    return F.when(zero, NAN).when(rem * b < 0.0, rem + b).otherwise(rem)


def power(a, b) -> Column:
    """``a ** b``; a base of 1 (or -1 with an infinite exponent) gives 1."""
    a, b = _col(a), _col(b)
    one = (a == 1.0) | ((a == -1.0) & (F.abs(b) == INF)) | (b == 0.0)
    return F.when(one, 1.0).otherwise(F.pow(a, b))


def log(x) -> Column:
    x = _col(x)
    return F.when(x == 0.0, -INF).when(x < 0.0, NAN).otherwise(F.ln(x))


def log10(x) -> Column:
    x = _col(x)
    return F.when(x == 0.0, -INF).when(x < 0.0, NAN).otherwise(F.log10(x))


def minimum(a, b) -> Column:
    """Smaller operand; NaN when either is NaN (``least`` would skip it)."""
    a, b = _col(a), _col(b)
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.least(a, b))


def maximum(a, b) -> Column:
    return F.greatest(_col(a), _col(b))  # NaN is the largest double in Spark


def atan2(a, b) -> Column:
    """Angle of ``(b, a)`` with the sign of zeros respected (Spark drops it)."""
    a, b = _col(a), _col(b)
    left = (b < 0.0) | ((b == 0.0) & (_zero_sign(b) < 0))
    return F.when((a == 0.0) & left, _zero_sign(a) * math.pi).otherwise(F.atan2(a, b))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


#: one-argument functions of the field calculator
UNARY = {
    "sqrt": F.sqrt, "exp": F.exp, "log": log, "log10": log10, "abs": F.abs, "sign": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}
#: two-argument functions of the field calculator
BINARY = {"atan2": atan2, "min": minimum, "max": maximum, "pow": power}
