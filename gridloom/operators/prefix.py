"""Running totals and dense numbering without a single-partition window.

Positions are cut into blocks; each block is scanned on its own, and what comes
before it is a scan of the block totals, cut again until one window can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import shape as S

BLOCK = 1 << 16


def running(frame: DataFrame, line: Column, position: Column, length: int, total, block: int = BLOCK) -> DataFrame:
    """frame (with v) plus column run: total of v over the positions of a line up to and with each row's.

    total is F.sum or F.product, which also combines the totals of blocks.
    """
    f = frame.withColumns({"_line": line, "_pos": position})
    upto = Window.partitionBy("_line").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    if length <= block:
        return f.withColumn("run", total("v").over(upto)).drop("_line", "_pos")
    f = f.withColumn("_block", S.div(F.col("_pos"), block))
    inside = Window.partitionBy("_line", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = f.groupBy("_line", "_block").agg(total("v").alias("v"))
    sums = running(sums.withColumnsRenamed({"_line": "_l", "_block": "_b"}), F.col("_l"), F.col("_b"), -(-length // block), total, block)
    before = sums.select(F.col("_l").alias("_line"), (F.col("_b") + 1).alias("_block"), F.col("run").alias("_before"))
    f = f.withColumn("run", total("v").over(inside)).join(before, ["_line", "_block"], "left")
    joined = F.col("run") * F.coalesce("_before", F.lit(1.0)) if total is F.product else F.col("run") + F.coalesce("_before", F.lit(0.0))
    return f.withColumn("run", joined).drop("_line", "_pos", "_block", "_before")


def renumbered(frame: DataFrame, length: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """frame (lin, v) with lin replaced by 0, 1, 2, ... in its order, and the number of rows.

    The rows of each block are counted once, by a job; the table of counts is kept for the frame.
    """
    f = frame.withColumn("_block", S.div(F.col("lin"), block))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("lin")).cast("bigint") - 1
    counts = f.groupBy("_block").agg(F.count("*").cast("double").alias("v")).cache()
    total = int(counts.agg(F.sum("v")).first()[0] or 0)
    if length <= block:
        return f.withColumn("lin", rank).drop("_block"), total
    counts = running(counts.withColumnRenamed("_block", "_b"), F.lit(0), F.col("_b"), -(-length // block), F.sum, block)
    before = counts.select(F.col("_b").alias("_block"), (F.col("run") - F.col("v")).cast("bigint").alias("_before"))
    return f.withColumn("lin", rank).join(before, "_block").withColumn("lin", F.col("lin") + F.col("_before")).select("lin", "v"), total
