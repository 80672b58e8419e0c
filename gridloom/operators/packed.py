"""Matrices with one array of doubles per row: last-axis operators are projections, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import GridArray
from ..functions.ieee import nan


@dataclass(frozen=True)
class PackedRows:
    """Frame (i, row) of a matrix; width is modest, the number of rows is not."""

    frame: DataFrame
    shape: tuple[int, int]

    @classmethod
    def of(cls, table: DataFrame, key: str, column: str, shape) -> PackedRows:
        return cls(table.select(F.col(key).cast("bigint").alias("i"), F.col(column).cast("array<double>").alias("row")), tuple(shape))

    def _vector(self, value: Column) -> GridArray:
        return GridArray.of(self.frame.select(F.col("i").alias("lin"), value.alias("v")), (self.shape[0],))

    def reduced(self, name: str) -> Column:
        """A reduction of each row; a NaN is the largest value, and a minimum that meets one is NaN."""
        row = F.col("row")
        total = F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
        return {
            "sum": lambda: total,
            "mean": lambda: total / F.lit(float(self.shape[1])),
            "prod": lambda: F.aggregate(row, F.lit(1.0), lambda s, x: s * x),
            "max": lambda: F.array_max(row),
            "min": lambda: F.when(F.exists(row, F.isnan), nan()).otherwise(F.array_min(row)),
            "argmax": lambda: (F.array_position(row, F.array_max(row)) - 1).cast("double"),
            "argmin": lambda: (F.array_position(row, F.array_min(row)) - 1).cast("double"),
        }[name]()

    def sum_rows(self) -> GridArray:
        return self._vector(self.reduced("sum"))

    def max_rows(self) -> GridArray:
        return self._vector(self.reduced("max"))

    def min_rows(self) -> GridArray:
        return self._vector(self.reduced("min"))

    def dot(self, weights: list[float]) -> GridArray:
        """Product with a vector of width numbers."""
        fixed = F.array(*[F.lit(float(w)) for w in weights])
        return self._vector(F.aggregate(F.zip_with("row", fixed, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))

    def cells(self) -> GridArray:
        cells = self.frame.select("i", F.posexplode("row").alias("j", "v"))
        return GridArray.of(cells.select((F.col("i") * self.shape[1] + F.col("j")).alias("lin"), "v"), self.shape)
