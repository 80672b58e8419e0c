"""Joining arrays along an axis: unions with shifted indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import GridArray
from ..errors import ShapeMismatchError
from ..plans import shape as S
from .views import expand_dims


def concatenate(arrays: list[GridArray], axis: int) -> GridArray:
    if not arrays:
        raise ShapeMismatchError("no arrays")
    first = arrays[0]
    axis = S.axis_of(axis, first.ndim)
    for a in arrays:
        if a.ndim != first.ndim or a.shape[:axis] + a.shape[axis + 1 :] != first.shape[:axis] + first.shape[axis + 1 :]:
            raise ShapeMismatchError(f"{a.shape} and {first.shape} differ beyond axis {axis}")
    shape = first.shape[:axis] + (sum(a.shape[axis] for a in arrays),) + first.shape[axis + 1 :]
    parts, before = [], 0
    for a in arrays:
        at = [S.coordinate(F.col("lin"), a.shape, k) for k in range(a.ndim)]
        at[axis] = at[axis] + F.lit(before).cast("bigint")
        parts.append(a.base.select(S.relinear(at, shape).alias("lin"), a.value.alias("v")))
        before += a.shape[axis]
    return GridArray.of(reduce(DataFrame.unionByName, parts), shape)


def stack(arrays: list[GridArray], axis: int) -> GridArray:
    """Along a new axis."""
    if not arrays:
        raise ShapeMismatchError("no arrays")
    if any(a.shape != arrays[0].shape for a in arrays):
        raise ShapeMismatchError("shapes differ")
    wide = [expand_dims(a, axis) for a in arrays]
    return concatenate(wide, axis % wide[0].ndim)


def vstack(arrays: list[GridArray]) -> GridArray:
    """Along axis 0; vectors become rows."""
    return concatenate([expand_dims(a, 0) if a.ndim == 1 else a for a in arrays], 0)


def hstack(arrays: list[GridArray]) -> GridArray:
    """Along axis 1, or axis 0 for vectors."""
    return concatenate(arrays, 0 if arrays and arrays[0].ndim == 1 else 1)
