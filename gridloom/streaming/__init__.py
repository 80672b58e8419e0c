"""Arrays over streaming frames.

Projections (elementwise operators of arrays over one frame, views, slices) work
on streaming frames as they are.  This module adds the reduction of a stream of
cell updates by axis, kept up to date as batches arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import shape as S


def running_axis_sum(cells: DataFrame, shape, axis: int) -> DataFrame:
    """Frame (lin, v) of the sums along an axis of a stream of cells (lin, v); write it in update or complete mode."""
    shape = S.checked(shape)
    axis = S.axis_of(axis, len(shape))
    others = [k for k in range(len(shape)) if k != axis]
    out = S.relinear([S.coordinate(F.col("lin"), shape, k) for k in others], tuple(shape[k] for k in others))
    return cells.select(out.alias("lin"), "v").groupBy("lin").agg(F.sum("v").alias("v"))
