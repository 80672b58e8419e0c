"""GridArray: a dense N-dimensional array of doubles as a Spark relation.

An array is a frame with one row per cell, a bigint row-major index ``lin``, and
a value expression over that frame; its shape is known on the driver.  Arrays
over one frame combine as projections; others meet in joins chosen by shape.
Every shape error is raised at once; nothing runs until a value is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IndexRangeError, ShapeMismatchError
from .plans import shape as S

#: Arrays of at most so many cells (16 bytes each) are broadcast in joins.
BROADCAST_CELLS = 1 << 20
#: Most cells that a text form shows.
PRINT_CELLS = 10_000


class GridArray:
    """Immutable array; see the modules in operators for what it can do."""

    def __init__(self, base: DataFrame, value: Column, shape, packed=None, flipped: GridArray | None = None):
        """packed holds the same matrix with one array per row, flipped the array that this one is the transpose of, where known."""
        self.base, self.value, self.shape = base, value, S.checked(shape)
        self.packed, self.flipped = packed, flipped

    @classmethod
    def of(cls, frame: DataFrame, shape) -> GridArray:
        """From a frame with columns lin and v."""
        return cls(frame, F.col("v"), shape)

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def frame(self) -> DataFrame:
        """The cells as (lin, v)."""
        return self.base.select("lin", self.value.alias("v"))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return S.size(self.shape)

    def project(self, value: Column) -> GridArray:
        """Another value for each cell of the same frame."""
        return GridArray(self.base, value, self.shape)

    def cells(self) -> DataFrame:
        """(i0, i1, ..., v): coordinates and values."""
        lin = F.col("lin")
        return self.base.select(*[S.coordinate(lin, self.shape, k).alias(f"i{k}") for k in range(self.ndim)], self.value.alias("v"))

    def _place(self, index) -> int:
        if len(index) != self.ndim or any(not 0 <= i < n for i, n in zip(index, self.shape, strict=True)):
            raise IndexRangeError(f"index {tuple(index)} does not fit shape {self.shape}")
        return sum(i * s for i, s in zip(index, S.strides(self.shape), strict=True))

    def at(self, *index: int) -> float:
        """Value of one cell; indices are not negative."""
        return self.base.where(F.col("lin") == self._place(index)).select(self.value).first()[0]

    def set(self, v: float, *index: int) -> GridArray:
        """The array with one cell replaced."""
        return self.project(F.when(F.col("lin") == self._place(index), F.lit(float(v))).otherwise(self.value))

    def copy(self) -> GridArray:
        return GridArray(self.base, self.value, self.shape)

    def persist_to(self, path: str) -> GridArray:
        """Written as Parquet and read back: cuts the plan's lineage."""
        self.frame.write.mode("overwrite").parquet(path)
        return GridArray.of(self.spark.read.schema("lin bigint, v double").parquet(path), self.shape)

    def to_list(self) -> list[float]:
        """All values in row-major order, for arrays of PRINT_CELLS at most."""
        if self.size > PRINT_CELLS:
            raise ShapeMismatchError(f"{self.size} cells are too many to collect")
        return [r[1] for r in sorted(self.frame.collect())] if self.size else []

    def __str__(self) -> str:
        return f"Array(shape=[{' '.join(map(str, self.shape))}], data=[{' '.join(map(_short, self.to_list()))}])"


def _short(x: float) -> str:
    """Shortest form that reads back, with an exponent below 1e-4 and from 1e21 on."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    mantissa, exponent = f"{x:.17g}", 0
    for digits in range(1, 18):
        if float(text := f"{x:.{digits - 1}e}") == x:
            mantissa, exponent = text.split("e")
            break
    exponent = int(exponent)
    if x and not -4 <= exponent < 21:
        return f"{mantissa}e{'+' if exponent >= 0 else '-'}{abs(exponent):02d}"
    decimals = max(0, len(mantissa.partition(".")[2]) - exponent)
    return f"{x:.{decimals}f}"
