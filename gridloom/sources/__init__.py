"""Arrays from tables: a dense unique key is the index, columns are values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import GridArray
from ..operators.packed import PackedRows


def vectors(table: DataFrame, key: str, *columns: str, length: int | None = None) -> list[GridArray]:
    """One vector for each column, all over one frame; the key runs from 0 without gaps (counted unless length is given)."""
    length = table.count() if length is None else length
    base = table.select(F.col(key).cast("bigint").alias("lin"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return [GridArray(base, F.col(f"c{k}"), (length,)) for k in range(len(columns))]


def vector(table: DataFrame, key: str, column: str, length: int | None = None) -> GridArray:
    return vectors(table, key, column, length=length)[0]


def rows_matrix(table: DataFrame, key: str, column: str, width: int, length: int | None = None) -> GridArray:
    """Matrix from a column of arrays that all hold width numbers; reductions of its rows and products take the arrays as they are."""
    length = table.count() if length is None else length
    cells = table.select(F.col(key).cast("bigint").alias("i"), F.posexplode(column).alias("j", "x"))
    lin = F.col("i") * F.lit(width).cast("bigint") + F.col("j")
    cells = cells.select(lin.alias("lin"), F.col("x").cast("double").alias("v"))
    return GridArray(cells, F.col("v"), (length, width), packed=PackedRows.of(table, key, column, (length, width)))


def columns_matrix(table: DataFrame, key: str, *columns: str, length: int | None = None) -> GridArray:
    """Matrix (rows, columns) from several numeric columns, without a shuffle."""
    length = table.count() if length is None else length
    parts = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    cells = table.select(F.col(key).cast("bigint").alias("i"), parts.alias("x"))
    return GridArray.of(cells.select((F.col("i") * len(columns) + F.col("x.j")).alias("lin"), F.col("x.v").alias("v")), (length, len(columns)))


def write(a: GridArray, path: str) -> None:
    """As Parquet (lin, v), sorted within files so that slices prune row groups."""
    a.frame.sortWithinPartitions("lin").write.mode("overwrite").parquet(path)


def read(spark, path: str, shape) -> GridArray:
    return GridArray.of(spark.read.schema("lin bigint, v double").parquet(path), shape)
