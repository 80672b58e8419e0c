"""New arrays; all are projections of a range."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..array import GridArray
from ..errors import ShapeMismatchError
from ..plans import shape as S

def _lin():
    return F.col("id").alias("lin")


def full(spark: SparkSession, v: float, *shape: int) -> GridArray:
    shape = S.checked(shape)
    return GridArray.of(spark.range(S.size(shape)).select(_lin(), F.lit(float(v)).alias("v")), shape)


def new(spark: SparkSession, *shape: int) -> GridArray:
    """Zeros; without dimensions a scalar."""
    return full(spark, 0.0, *shape)


def zeros(spark: SparkSession, *shape: int) -> GridArray:
    return full(spark, 0.0, *shape)


def ones(spark: SparkSession, *shape: int) -> GridArray:
    return full(spark, 1.0, *shape)


def scalar(spark: SparkSession, v: float) -> GridArray:
    return full(spark, v)


def from_data(spark: SparkSession, data, *shape: int) -> GridArray:
    """From a list of numbers on the driver."""
    shape, data = S.checked(shape), [float(x) for x in data]
    if len(data) != S.size(shape):
        raise ShapeMismatchError(f"{len(data)} values do not fit {shape}")
    return GridArray.of(spark.createDataFrame(list(enumerate(data)), "lin bigint, v double"), shape)


def arange(spark: SparkSession, start: float, stop: float, step: float) -> GridArray:
    """start, start + step, ... before stop."""
    if step == 0:
        raise ShapeMismatchError("step 0")
    n = max(0, math.ceil((stop - start) / step))
    return GridArray.of(spark.range(n).select(_lin(), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v")), (n,))


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> GridArray:
    """num values from start to stop, both included."""
    if num < 0:
        raise ShapeMismatchError(f"{num} values")
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    v = F.lit(float(start)) + F.col("id") * F.lit(step)
    if num > 1:
        v = F.when(F.col("id") == num - 1, F.lit(float(stop))).otherwise(v)
    return GridArray.of(spark.range(num).select(_lin(), v.alias("v")), (num,))


def eye(spark: SparkSession, n: int, m: int = 0, k: int = 0) -> GridArray:
    """Ones on the k-th diagonal; m <= 0 stands for n."""
    shape = S.checked((n, m if m > 0 else n))
    lin = F.col("id")
    on = S.coordinate(lin, shape, 1) == S.coordinate(lin, shape, 0) + k
    return GridArray.of(spark.range(S.size(shape)).select(_lin(), F.when(on, 1.0).otherwise(0.0).alias("v")), shape)


def identity(spark: SparkSession, n: int) -> GridArray:
    return eye(spark, n, n, 0)
