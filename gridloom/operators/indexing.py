"""Selection by masks and by lists of indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import BROADCAST_CELLS, GridArray
from ..errors import ShapeMismatchError
from ..functions import ieee
from ..plans import shape as S
from .elementwise import aligned
from .prefix import renumbered


def mask_select(a: GridArray, mask: GridArray) -> GridArray:
    """Cells where the mask is not zero, as a vector in row-major order (counts them: one job)."""
    if S.broadcast(a.shape, mask.shape) != a.shape:
        raise ShapeMismatchError(f"mask {mask.shape} is larger than {a.shape}")
    x, m = aligned(a, mask)
    kept = x.base.where(ieee.truthy(m.value)).select("lin", x.value.alias("v"))
    frame, count = renumbered(kept, a.size)
    return GridArray.of(frame, (count,))


def nonzero(a: GridArray) -> GridArray:
    """Flat indices of the cells that are not zero, as doubles (counts them: one job)."""
    kept = a.base.where(ieee.truthy(a.value)).select("lin", F.col("lin").cast("double").alias("v"))
    frame, count = renumbered(kept, a.size)
    return GridArray.of(frame, (count,))


def take(a: GridArray, *indices: int) -> GridArray:
    """Cells of the flattened array at the indices, which may repeat and be negative."""
    n = a.size
    if any(not -n <= i < n for i in indices):
        raise ShapeMismatchError(f"an index is out of range for {n} cells")
    wanted = a.spark.createDataFrame([(k, i % n) for k, i in enumerate(indices)], "pos bigint, at bigint")
    wanted = F.broadcast(wanted) if n and len(indices) <= BROADCAST_CELLS else wanted
    found = a.frame.join(wanted, F.col("lin") == F.col("at"))
    return GridArray.of(found.select(F.col("pos").alias("lin"), "v"), (len(indices),))
