"""Column expressions with IEEE-754 results where Spark's own differ.

All take and give double columns, stay inside whole-stage code generation, and
never raise: division by zero gives infinities or NaN, NaN equals nothing, and
logarithms of zero and of negative numbers are -Infinity and NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def lit(x: float) -> Column:
    return F.lit(float(x))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, lit(-1))).otherwise(a / F.when(b != 0, b))


def _either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def _mask(condition: Column) -> Column:
    return F.when(condition, lit(1)).otherwise(lit(0))


def equal(a: Column, b: Column) -> Column:
    return _mask(~_either_nan(a, b) & (a == b))


def not_equal(a: Column, b: Column) -> Column:
    return _mask(_either_nan(a, b) | (a != b))


def greater(a: Column, b: Column) -> Column:
    return _mask(~_either_nan(a, b) & (a > b))


def greater_equal(a: Column, b: Column) -> Column:
    return _mask(~_either_nan(a, b) & (a >= b))


def less(a: Column, b: Column) -> Column:
    return _mask(~_either_nan(a, b) & (a < b))


def less_equal(a: Column, b: Column) -> Column:
    return _mask(~_either_nan(a, b) & (a <= b))


def maximum(a: Column, b: Column) -> Column:
    """Larger of two; +Infinity wins over NaN, NaN over all else."""
    return F.when((a == inf()) | (b == inf()), inf()).otherwise(F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    """Smaller of two; -Infinity wins over NaN, NaN over all else."""
    return F.when((a == -inf()) | (b == -inf()), -inf()).when(_either_nan(a, b), nan()).otherwise(F.least(a, b))


def truthy(a: Column) -> Column:
    return a != 0


def where(c: Column, t: Column, f: Column) -> Column:
    return F.when(truthy(c), t).otherwise(f)


def clip(v: Column, lo: float, hi: float) -> Column:
    """Bounds that are NaN do nothing; NaN passes."""
    out = v
    if not math.isnan(hi):
        out = F.when(~F.isnan(out) & (out > hi), lit(hi)).otherwise(out)
    if not math.isnan(lo):
        out = F.when(~F.isnan(v) & (v < lo), lit(lo)).otherwise(out)
    return out


def neg(v: Column) -> Column:
    return -v


def absolute(v: Column) -> Column:
    return F.abs(v)


def sqrt(v: Column) -> Column:
    return F.sqrt(v)


def exp(v: Column) -> Column:
    return F.exp(v)


def _log(f):
    return lambda v: F.when(F.isnan(v) | (v < 0), nan()).when(v == 0, -inf()).otherwise(f(v))


log, log2, log10 = _log(F.ln), _log(F.log2), _log(F.log10)


def sin(v: Column) -> Column:
    return F.sin(v)


def cos(v: Column) -> Column:
    return F.cos(v)


def tan(v: Column) -> Column:
    return F.tan(v)


def _whole(f):
    return lambda v: F.when(F.abs(v) < 2.0**52, f(v).cast("double")).otherwise(v)


floor, ceil = _whole(F.floor), _whole(F.ceil)


def rint(v: Column) -> Column:
    """Half away from zero."""
    return F.when(F.abs(v) < 2.0**52, F.round(v, 0)).otherwise(v)


def square(v: Column) -> Column:
    return v * v


def power(v: Column, p: float) -> Column:
    """1 to any power and anything to the power 0 is 1, as is -1 to an infinite one."""
    if p == 0:
        return lit(1)
    if math.isnan(p):
        return F.when(v == 1, lit(1)).otherwise(nan())
    out = F.pow(v, lit(p))
    return F.when(F.abs(v) == 1, lit(1)).otherwise(out) if math.isinf(p) else out
