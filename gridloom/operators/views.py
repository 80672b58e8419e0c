"""Shape changes and slices: metadata where the order of cells stays, else projections and filters of lin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import BROADCAST_CELLS, GridArray
from ..errors import AxisError, IndexRangeError, ShapeMismatchError
from ..plans import shape as S

#: Longest array that stretching puts in a row, and cells of a result for each task of a stretched small array.
SPAN, RANGE_CELLS = 4_096, 1 << 24


def _moved(a: GridArray, lin, shape, keep=None) -> GridArray:
    base = a.base if keep is None else a.base.where(keep)
    return GridArray.of(base.select(lin.cast("bigint").alias("lin"), a.value.alias("v")), shape)


def reshape(a: GridArray, *shape: int) -> GridArray:
    return GridArray(a.base, a.value, S.inferred(shape, a.size))


def ravel(a: GridArray) -> GridArray:
    return reshape(a, a.size)


def flatten(a: GridArray) -> GridArray:
    return reshape(a, a.size)


def transpose(a: GridArray) -> GridArray:
    """All axes in reverse."""
    if a.ndim < 2:
        return a.copy()
    if a.flipped is not None:
        return a.flipped
    shape = a.shape[::-1]
    at = [S.coordinate(F.col("lin"), a.shape, k) for k in range(a.ndim)]
    moved = _moved(a, S.relinear(at[::-1], shape), shape)
    return GridArray(moved.base, moved.value, shape, flipped=a)


def expand_dims(a: GridArray, axis: int) -> GridArray:
    n = a.ndim + 1
    if not -n <= axis < n:
        raise AxisError(f"axis {axis} is out of range for {n} dimensions")
    axis %= n
    return GridArray(a.base, a.value, a.shape[:axis] + (1,) + a.shape[axis:])


def squeeze(a: GridArray, *axes: int) -> GridArray:
    """Without the given axes of length 1, or without all of them."""
    gone = {S.axis_of(k, a.ndim) for k in axes} if axes else {k for k, n in enumerate(a.shape) if n == 1}
    if any(a.shape[k] != 1 for k in gone):
        raise ShapeMismatchError(f"axes {axes} of {a.shape} are not all of length 1")
    return GridArray(a.base, a.value, tuple(n for k, n in enumerate(a.shape) if k not in gone))


def slice_(a: GridArray, *index: S.Index) -> GridArray:
    """One Index for each axis."""
    if len(index) != a.ndim:
        raise IndexRangeError(f"{len(index)} indices for {a.ndim} dimensions")
    lin, keep, at, shape = F.col("lin"), F.lit(True), [], []
    for k, (ix, n) in enumerate(zip(index, a.shape, strict=True)):
        first, step, count, drops = ix.resolve(n)
        c = S.coordinate(lin, a.shape, k)
        if count == n and step == 1 and not drops:
            at.append(c)
            shape.append(n)
            continue
        lo, hi = sorted((first, first + (max(count, 1) - 1) * step))
        keep = keep & (F.lit(False) if not count else c.between(lo, hi))
        if abs(step) > 1:
            keep = keep & (S.mod(c - F.lit(lo), abs(step)) == 0)
        if not drops:
            moved = c - F.lit(first) if step > 0 else F.lit(first) - c
            at.append(S.div(moved, abs(step)))
            shape.append(count)
    return _moved(a, S.relinear(at, tuple(shape)), shape, keep)


def broadcast_to(a: GridArray, shape) -> GridArray:
    """Cells repeated along the axes that the shape adds or stretches."""
    shape = S.checked(shape)
    if S.broadcast(a.shape, shape) != shape:
        raise S.BroadcastError(f"{a.shape} does not broadcast to {shape}")
    own = (1,) * (len(shape) - a.ndim) + a.shape
    if own == shape:
        return GridArray(a.base, a.value, shape)
    if 0 in shape:
        return GridArray.of(a.frame.where(F.lit(False)), shape)
    lin = F.col("lin")
    if a.size <= BROADCAST_CELLS:  # the cells of the result fetch theirs, so work spreads by the result
        total = S.size(shape)
        cells = a.spark.range(0, total, 1, max(a.spark.sparkContext.defaultParallelism, total // RANGE_CELLS)).withColumnRenamed("id", "lin")
        at = [S.coordinate(lin, shape, k) if n == shape[k] else F.lit(0).cast("bigint") for k, n in enumerate(own)]
        side = a.frame.select(F.col("lin").alias("from"), "v")
        return GridArray.of(cells.withColumn("at", S.relinear(at, own)).join(F.broadcast(side), F.col("at") == F.col("from")).select("lin", "v"), shape)
    frame, at = a.frame, []
    for k, (n, m) in enumerate(zip(own, shape, strict=True)):
        if n != m:
            frame = _stretched(frame, f"x{k}", m)
        at.append(F.col(f"x{k}") if n != m else S.coordinate(lin, own, k))
    return GridArray.of(frame.select(S.relinear(at, shape).alias("lin"), "v"), shape)


def _stretched(frame, name: str, m: int):
    """Each row m times, with its turn in a column; no row holds an array of more than SPAN numbers."""
    step = 1
    while step * SPAN < m:
        step *= SPAN
    turn = F.lit(0).cast("bigint")
    while step:
        upto = F.least(F.lit(m - 1), turn + step * SPAN - 1) if step * SPAN < m else F.lit(m - 1)
        frame = frame.withColumn(name, F.explode(F.sequence(turn, upto.cast("bigint"), F.lit(step).cast("bigint"))))
        turn, step = F.col(name), step // SPAN
    return frame
