"""Elementwise operators; two arrays over one frame need no join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import BROADCAST_CELLS, GridArray
from ..errors import BroadcastError, ShapeMismatchError
from ..functions import ieee
from ..plans import shape as S
from .views import broadcast_to


def aligned(*arrays: GridArray) -> tuple[GridArray, ...]:
    """The arrays over one frame and in their common shape.

    Arrays that share a frame and shape meet as columns.  An array that has the
    common shape leads; others join it on the lin that its coordinates give, by
    broadcast where their cells are few.  Where none has it, the first is stretched.
    """
    shape = S.broadcast(*[a.shape for a in arrays])
    if all(a.base is arrays[0].base and a.shape == shape for a in arrays):
        return arrays
    lead = next((a for a in arrays if a.shape == shape), None)
    if lead is None:
        arrays = (broadcast_to(arrays[0], shape), *arrays[1:])
        lead = arrays[0]
    own = [k for k, a in enumerate(arrays) if a.base is lead.base and a.shape == shape]
    frame = lead.base.select("lin", *[arrays[k].value.alias(f"v{k}") for k in own])
    if 0 in shape:
        empty = lead.base.where(F.lit(False)).select("lin", *[F.lit(0.0).alias(f"v{k}") for k in range(len(arrays))])
        return tuple(GridArray(empty, F.col(f"v{k}"), shape) for k in range(len(arrays)))
    for k, a in enumerate(arrays):
        if k in own:
            continue
        full = (1,) * (len(shape) - a.ndim) + a.shape
        at = [S.coordinate(F.col("lin"), shape, d) if n == shape[d] else F.lit(0).cast("bigint") for d, n in enumerate(full)]
        key = F.col("lin") if full == shape else S.relinear(at, full)
        side = a.base.select(F.col("lin").alias(f"l{k}"), a.value.alias(f"v{k}"))
        side = F.broadcast(side) if a.size <= BROADCAST_CELLS else side
        frame = frame.withColumn(f"k{k}", key).join(side, F.col(f"k{k}") == F.col(f"l{k}")).drop(f"k{k}", f"l{k}")
    return tuple(GridArray(frame, F.col(f"v{k}"), shape) for k in range(len(arrays)))


def binary(f: Callable[[Column, Column], Column], a: GridArray, b: GridArray | float) -> GridArray:
    if not isinstance(b, GridArray):
        return a.project(f(a.value, F.lit(float(b))))
    a, b = aligned(a, b)
    return a.project(f(a.value, b.value))


def _binary(f):
    def op(a: GridArray, b: GridArray | float) -> GridArray:
        return binary(f, a, b)

    op.__name__ = f.__name__
    op.__doc__ = f"Elementwise {f.__name__.replace('_', ' ')} with broadcasting; a plain number is a scalar."
    return op


def _unary(f):
    def op(a: GridArray) -> GridArray:
        return a.project(f(a.value))

    op.__name__ = getattr(f, "__name__", "op")
    return op


add, sub, mul, div = map(_binary, (ieee.add, ieee.sub, ieee.mul, ieee.div))
equal, not_equal, greater, greater_equal, less, less_equal = map(_binary, (ieee.equal, ieee.not_equal, ieee.greater, ieee.greater_equal, ieee.less, ieee.less_equal))
maximum, minimum = map(_binary, (ieee.maximum, ieee.minimum))
add_scalar, sub_scalar, mul_scalar, div_scalar = add, sub, mul, div
neg, absolute, sqrt, exp, log, log2, log10, sin, cos, tan, floor, ceil, rint, square = map(_unary, (ieee.neg, ieee.absolute, ieee.sqrt, ieee.exp, ieee.log, ieee.log2, ieee.log10, ieee.sin, ieee.cos, ieee.tan, ieee.floor, ieee.ceil, ieee.rint, ieee.square))


def _into(op):
    def into(a: GridArray, b: GridArray, out: GridArray) -> GridArray:
        if out.shape != S.broadcast(a.shape, b.shape):
            raise BroadcastError(f"output shape {out.shape} does not fit {a.shape} and {b.shape}")
        return op(a, b)

    into.__name__ = f"{op.__name__}_into"
    into.__doc__ = f"{op.__name__} with the output's shape checked; frames are immutable, so the result is returned."
    return into


add_into, sub_into, mul_into, div_into = map(_into, (add, sub, mul, div))


def sqrt_into(a: GridArray, out: GridArray) -> GridArray:
    """sqrt with the output's shape checked; the result is returned."""
    if out.shape != a.shape:
        raise BroadcastError(f"output shape {out.shape} is not {a.shape}")
    return sqrt(a)


def power(a: GridArray, p: float) -> GridArray:
    return a.project(ieee.power(a.value, p))


def clip(a: GridArray, lo: float, hi: float) -> GridArray:
    if lo > hi:
        raise ShapeMismatchError(f"bounds {lo} > {hi}")
    return a.project(ieee.clip(a.value, lo, hi))


def where(c: GridArray, t: GridArray, f: GridArray) -> GridArray:
    """t where c is not zero, else f; all three broadcast."""
    c, t, f = aligned(c, t, f)
    return c.project(ieee.where(c.value, t.value, f.value))


def map_(a: GridArray, f: Callable[[Column], Column]) -> GridArray:
    """f maps the value column to a column (a pandas_udf will do, built-in functions are faster)."""
    return a.project(f(a.value).cast("double"))
