"""Products of vectors and matrices.

The plan follows from the shapes.  A matrix with its own transpose is summed up
row by row where rows are stored as arrays.  Few results over a long inner axis
are one partial product a task, added up once.  Otherwise a right side of few
cells goes to every task and meets row blocks in NumPy; larger pairs become
square blocks that join on the inner axis, whose partial blocks are added up in
two steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import BROADCAST_CELLS, GridArray
from ..errors import LinalgError
from ..plans import shape as S
from .views import transpose

#: Side of a block, and partial blocks that one task adds up at a time.
SIDE, PARTIALS = 512, 32
#: Most cells of a result that each task holds whole, and of both sides that it multiplies at a time.
INNER_CELLS, SLAB_CELLS = 1 << 18, 1 << 20


def _cells(a: GridArray, i: str, j: str) -> DataFrame:
    lin = F.col("lin")
    return a.base.select(S.coordinate(lin, a.shape, 0).alias(i), S.coordinate(lin, a.shape, 1).alias(j), a.value.alias("v"))


def matmul(a: GridArray, b: GridArray) -> GridArray:
    """(m, k) by (k, n)."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise LinalgError(f"{a.shape} by {b.shape}")
    (m, k), n = a.shape, b.shape[1]
    if not m * k * n:
        from .creation import zeros

        return zeros(a.spark, m, n)
    if a.flipped is b and b.packed is not None and m * n <= INNER_CELLS:
        return _gram(b)
    if m * n <= INNER_CELLS and k > max(m, n):
        return _by_inner(a, b)
    if b.size <= BROADCAST_CELLS:
        return _by_rows(a, b)
    if a.size <= BROADCAST_CELLS:
        return transpose(_by_rows(transpose(b), transpose(a)))
    return _by_blocks(a, b)


def _summed(partial: DataFrame, shape) -> GridArray:
    """Partial products (lin, v) of tasks, added up."""
    return GridArray.of(partial.groupBy("lin").agg(F.sum("v").alias("v")), shape)


def _partial(total):
    """A task's partial product as a record batch (lin, v); none if it had no rows."""
    import pyarrow as pa

    if total is not None:
        yield pa.record_batch([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], ["lin", "v"])


def _gram(a: GridArray) -> GridArray:
    """The transpose of a times a, from the packed rows of a: one partial product a task and no other shuffle."""
    import numpy as np

    width = a.shape[1]

    def run(batches):
        total = None
        for batch in batches:
            rows = np.asarray(batch.column(0).flatten()).reshape(-1, width)
            total = rows.T @ rows if total is None else total + rows.T @ rows
        yield from _partial(total)

    return _summed(a.packed.frame.select("row").mapInArrow(run, "lin bigint, v double"), (width, width))


def _by_inner(a: GridArray, b: GridArray) -> GridArray:
    """Slabs of the inner axis: cells of both sides meet by slab, and each task adds up its products."""
    import numpy as np

    (m, k), n = a.shape, b.shape[1]
    depth = max(1, min(k, SLAB_CELLS // (m + n)))

    def run(batches):
        total, at, left, right = None, None, np.zeros((m, depth)), np.zeros((depth, n))
        for batch in batches:
            slab, second, outer, inner, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            edge = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]]) if len(slab) else []
            for lo, hi in zip(edge, [*edge[1:], len(slab)], strict=False):
                if slab[lo] != at:
                    if at is not None:
                        total = left @ right if total is None else total + left @ right
                    at = slab[lo]
                    left[:], right[:] = 0, 0
                s, o, i, x = second[lo:hi], outer[lo:hi], inner[lo:hi] - at * depth, v[lo:hi]
                left[o[~s], i[~s]] = x[~s]
                right[i[s], o[s]] = x[s]
        if at is not None:
            total = left @ right if total is None else total + left @ right
        yield from _partial(total)

    sides = [_cells(x, *names).select(S.div(F.col("k"), depth).alias("slab"), F.lit(second).alias("second"), "o", "k", "v") for x, names, second in ((a, ("o", "k"), False), (b, ("k", "o"), True))]
    dealt = sides[0].unionByName(sides[1]).repartition("slab").sortWithinPartitions("slab")
    return _summed(dealt.mapInArrow(run, "lin bigint, v double"), (m, n))


def _by_rows(a: GridArray, b: GridArray) -> GridArray:
    """Row blocks of a, each multiplied by the whole of b (at most BROADCAST_CELLS cells, sent to every task)."""
    import numpy as np

    (m, k), n = a.shape, b.shape[1]
    cells, right = b.frame.toPandas(), np.zeros(k * n)
    right[cells["lin"].to_numpy()] = cells["v"].to_numpy()
    right = right.reshape(k, n)
    rows = max(1, min(SIDE, (1 << 22) // max(k, n)))
    if a.packed is not None:  # rows are in one place already

        def stored(batches):
            import pyarrow as pa

            for batch in batches:
                for lo in range(0, len(batch), rows):
                    part = batch.slice(lo, rows)
                    i = part.column(0).to_numpy()
                    out = np.asarray(part.column(1).flatten()).reshape(len(i), k) @ right
                    yield pa.record_batch([pa.array((i[:, None] * n + np.arange(n)).ravel()), pa.array(out.ravel())], ["lin", "v"])

        return GridArray.of(a.packed.frame.select("i", "row").mapInArrow(stored, "lin bigint, v double"), (m, n))

    def run(pdf):
        import pandas as pd

        block = int(pdf["block"].iloc[0])
        height = min(rows, m - block * rows)
        left = np.zeros((height, k))
        left[pdf["i"].to_numpy() - block * rows, pdf["k"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"lin": np.arange(height * n) + block * rows * n, "v": (left @ right).ravel()})

    blocks = _cells(a, "i", "k").withColumn("block", S.div(F.col("i"), rows)).groupBy("block")
    return GridArray.of(blocks.applyInPandas(run, "lin bigint, v double"), (m, n))


def _blocks(a: GridArray, i: str, j: str) -> DataFrame:
    import numpy as np

    def run(pdf):
        import pandas as pd

        block = np.zeros((SIDE, SIDE))
        block[pdf["r"].to_numpy() % SIDE, pdf["c"].to_numpy() % SIDE] = pdf["v"].to_numpy()
        return pd.DataFrame({i: [int(pdf["r"].iloc[0]) // SIDE], j: [int(pdf["c"].iloc[0]) // SIDE], f"{i}{j}": [block.tobytes()]})

    cells = _cells(a, "r", "c")
    return cells.groupBy(S.div(F.col("r"), SIDE).alias("br"), S.div(F.col("c"), SIDE).alias("bc")).applyInPandas(lambda pdf: run(pdf), f"{i} bigint, {j} bigint, {i}{j} binary")


def _by_blocks(a: GridArray, b: GridArray) -> GridArray:
    import numpy as np
    import pyarrow as pa

    m, n = a.shape[0], b.shape[1]

    def multiply(batches):
        for batch in batches:
            out = [(np.frombuffer(x.as_py()).reshape(SIDE, SIDE) @ np.frombuffer(y.as_py()).reshape(SIDE, SIDE)).tobytes() for x, y in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], ["p", "q", "k", "c"])

    def add(pdf):
        import pandas as pd

        total = np.zeros(SIDE * SIDE)
        for c in pdf["c"]:
            total += np.frombuffer(c)
        return pd.DataFrame({"p": pdf["p"].iloc[:1], "q": pdf["q"].iloc[:1], "k": [int(pdf["k"].min()) // PARTIALS], "c": [total.tobytes()]})

    schema = "p bigint, q bigint, k bigint, c binary"
    pairs = _blocks(a, "p", "k").join(_blocks(b, "k", "q"), "k").select("p", "q", "k", "pk", "kq")
    sums, left = pairs.mapInArrow(multiply, schema), -(-a.shape[1] // SIDE)
    while True:
        sums, left = sums.groupBy("p", "q", S.div(F.col("k"), PARTIALS).alias("g")).applyInPandas(lambda pdf: add(pdf), schema), -(-left // PARTIALS)
        if left <= 1:
            break

    def spread(batches):
        for batch in batches:
            for p, q, c in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                block = np.frombuffer(c).reshape(SIDE, SIDE)[: m - p * SIDE, : n - q * SIDE]
                lin = (np.arange(block.shape[0]) + p * SIDE)[:, None] * n + np.arange(block.shape[1]) + q * SIDE
                yield pa.record_batch([pa.array(lin.ravel()), pa.array(block.ravel())], ["lin", "v"])

    return GridArray.of(sums.mapInArrow(spread, "lin bigint, v double"), (m, n))


def dot(a: GridArray, b: GridArray) -> GridArray:
    """1-D by 1-D gives a scalar; otherwise a matrix product with 1-D sides as row or column."""
    if (a.ndim, b.ndim) == (2, 2):
        return matmul(a, b)
    if (a.ndim, b.ndim) == (1, 1):
        if a.shape != b.shape:
            raise LinalgError(f"{a.shape} by {b.shape}")
        from .elementwise import mul

        return GridArray.of(mul(a, b).frame.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).select(F.lit(0).cast("bigint").alias("lin"), "v"), ())
    if (a.ndim, b.ndim) == (2, 1):
        return _vector(a, b, 1)
    if (a.ndim, b.ndim) == (1, 2):
        return _vector(b, a, 0)
    raise LinalgError(f"ranks {a.ndim} and {b.ndim}")


def _vector(m: GridArray, v: GridArray, axis: int) -> GridArray:
    if m.shape[axis] != v.shape[0]:
        raise LinalgError(f"{m.shape} and {v.shape}")
    from .creation import zeros
    from .elementwise import mul
    from .reductions import sum_axis
    from .views import expand_dims

    if not m.shape[axis]:
        return zeros(m.spark, m.shape[1 - axis])
    return sum_axis(mul(m, v if axis == 1 else expand_dims(v, 1)), axis)


def inner(a: GridArray, b: GridArray) -> GridArray:
    """Sum of products over the last axis of both."""
    if (a.ndim, b.ndim) == (1, 1):
        return dot(a, b)
    if (a.ndim, b.ndim) != (2, 2) or a.shape[1] != b.shape[1]:
        raise LinalgError(f"{a.shape} and {b.shape}")
    return matmul(a, transpose(b))


def outer(a: GridArray, b: GridArray) -> GridArray:
    """All products of the cells of two flattened arrays."""
    from .elementwise import mul
    from .views import reshape

    return mul(reshape(a, a.size, 1), reshape(b, 1, b.size))
