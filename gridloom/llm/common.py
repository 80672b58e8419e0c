"""Shared folder, staged tables, heavy-hitter joins and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the regular expression class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot from this share of all rows on, so at most this many keys are hot.
HOT_KEYS = 1000
#: So many rows of two integers are no burden to one task, whichever keys they have.
PLAIN_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's spark.checkpoint.dir.

    Where it is unset a folder of this machine serves, but only if executors
    are threads of this process; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends in order."""
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, long before the driver's JVM ends."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, hot) -> DataFrame:
    """Left join of rows to a table of unique keys, whichever share of the rows a key has.

    hot is a condition on the table that holds for at most HOT_KEYS of its rows
    by construction; those are broadcast.  Rows so served get a key of their own
    in the shuffle join with the rest, and thus spread evenly.
    """
    values = [c for c in table.columns if c != table_key]
    first = table.where(hot).select(F.col(table_key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    rest = table.where(~hot).select(F.col(table_key).cast("string").alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = rows.join(F.broadcast(first), rows[key] == F.col("_hk"), "left")
    spread = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread))
    out = out.join(rest, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])


def components(edges: DataFrame, tag: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of (u, v) as (node, root), root the smallest node reachable.

    Alternates large-star and small-star rewrites of the edge table, which reach
    a forest of stars in about log² rounds; each round is written to the shared
    folder, and the round before it removed.  Nodes with very many neighbours are
    looked up by broadcast, HOT_KEYS at most a side.
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), tag)
    n, before = e.count(), None
    for _ in range(most):
        hot, few = F.col("n") >= F.lit(max(1000, 2 * n // HOT_KEYS + 1)), 2 * n <= PLAIN_ROWS
        keep = (lambda t: t) if few else (lambda t: stage(t, tag))
        meet = (lambda rows, t: rows.join(t, "u")) if few else (lambda rows, t, hot=hot: lookup(rows, "u", t, "u", hot))
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = meet(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), tag)
        # small star: a node and its smaller neighbours go to the least of them
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = meet(large, lower).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        old, e = e, stage(small.where("u <> v").distinct(), tag)
        drop(old, large, *(() if few else (least, lower)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        n, before = now[0], now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
