"""Reductions of whole arrays and of axes, and running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import GridArray
from ..errors import ShapeMismatchError
from ..functions.ieee import nan
from ..plans import shape as S
from .prefix import running

def _nan_min(v):
    return F.when(F.bool_or(F.isnan(v)), nan()).otherwise(F.min(v))


def _first_max(at):
    """Position of the first maximum; a NaN counts as the largest."""
    return F.max_by(at, F.struct(F.col("v"), -at))


def _first_min(at):
    return F.min_by(at, F.struct(F.col("v"), at))


_AGGREGATES = {"sum": lambda at: F.coalesce(F.sum(F.col("v")), F.lit(0.0)), "prod": lambda at: F.coalesce(F.product(F.col("v")), F.lit(1.0)), "mean": lambda at: F.avg(F.col("v")), "max": lambda at: F.max(F.col("v")), "min": lambda at: _nan_min(F.col("v")), "argmax": _first_max, "argmin": _first_min}


def whole_frame(a: GridArray, name: str):
    """The reduction as a frame of one row and column v."""
    return a.frame.agg(_AGGREGATES[name](F.col("lin")).alias("v"))


def _whole(name: str, of_empty=None):
    def op(a: GridArray):
        if not a.size:
            if of_empty is None:
                raise ShapeMismatchError(f"{name} of an empty array")
            return of_empty
        return whole_frame(a, name).first()[0]

    op.__name__ = name
    return op


sum_, prod = _whole("sum", 0.0), _whole("prod", 1.0)
mean, max_, min_, argmax, argmin = map(_whole, ("mean", "max", "min", "argmax", "argmin"))


def _axis(name: str):
    def op(a: GridArray, axis: int, keepdims: bool = False) -> GridArray:
        axis = S.axis_of(axis, a.ndim)
        if not a.shape[axis]:
            raise ShapeMismatchError(f"axis {axis} has length 0")
        shape, lin = S.reduced(a.shape, axis, keepdims), F.col("lin")
        if a.packed is not None and axis == 1:  # each row is in one place
            return GridArray.of(a.packed.frame.select(F.col("i").alias("lin"), a.packed.reduced(name).alias("v")), shape)
        others = [k for k in range(a.ndim) if k != axis]
        out = S.relinear([S.coordinate(lin, a.shape, k) for k in others], tuple(a.shape[k] for k in others))
        cells = a.base.select(out.alias("lin"), S.coordinate(lin, a.shape, axis).alias("at"), a.value.alias("v"))
        return GridArray.of(cells.groupBy("lin").agg(_AGGREGATES[name](F.col("at")).cast("double").alias("v")), shape)

    op.__name__ = f"{name}_axis"
    return op


sum_axis, prod_axis, max_axis, min_axis, mean_axis, argmax_axis, argmin_axis = map(_axis, ("sum", "prod", "max", "min", "mean", "argmax", "argmin"))


def _scan(total):
    def op(a: GridArray, axis: int) -> GridArray:
        axis = S.axis_of(axis, a.ndim)
        lin = F.col("lin")
        others = [k for k in range(a.ndim) if k != axis]
        line = S.relinear([S.coordinate(lin, a.shape, k) for k in others], tuple(a.shape[k] for k in others))
        run = running(a.frame, line, S.coordinate(lin, a.shape, axis), a.shape[axis], total)
        return GridArray.of(run.select("lin", F.col("run").alias("v")), a.shape)

    return op


cumsum, cumprod = _scan(F.sum), _scan(F.product)


def cumsum_flat(a: GridArray) -> GridArray:
    return cumsum(GridArray(a.base, a.value, (a.size,)), 0)


def cumprod_flat(a: GridArray) -> GridArray:
    return cumprod(GridArray(a.base, a.value, (a.size,)), 0)
