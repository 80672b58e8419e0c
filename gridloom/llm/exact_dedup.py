"""Exact dedup by skew-safe combining, in DataFrame functions only.

Rows are combined on their map task, then by (digest, salt), then by digest;
the whole normalised text is a grouping key each time, so a digest alone never
decides.  A text with a third of all rows costs one row per map task and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, lookup, stage

_BIG = "decimal(38,0)"


def _rank(chars, key):
    """One number that is larger for more code points, then for a smaller key; null keys last."""
    big = lambda x: F.lit(str(x)).cast(_BIG)
    of_key = F.when(key.isNull(), big(0)).otherwise(big(2**64 + 2**63 - 1) - key.cast(_BIG))
    return (chars.cast(_BIG) * big(2**65) + of_key.cast(_BIG)).cast(_BIG)


def _key_of(rank):
    rest = (rank % F.lit(str(2**65)).cast(_BIG)).cast(_BIG)
    return F.when(rest != 0, (F.lit(str(2**64 + 2**63 - 1)).cast(_BIG) - rest).cast("bigint"))


def _marked(docs: DataFrame, text: str, key: str, salts: int, digest) -> DataFrame:
    """The columns of docs as c0, c1, ... with _id, keep_id, group_size, kept and text_sha256."""
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    raw = F.coalesce(F.col(f"c{docs.columns.index(text)}"), F.lit(""))
    norm = F.regexp_replace(raw, r"[\x20\x09-\x0D]+", "")
    sha = F.sha2(F.encode(F.col("_norm"), "UTF-8"), 256)
    rows = inner.select("*", F.col(f"c{docs.columns.index(key)}").alias("_id"), F.length(raw).alias("_chars"), norm.alias("_norm"))
    rows = rows.withColumn("_digest", digest(F.col("_norm")) if digest else sha)
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_norm")
    salted = salted.agg(F.max(_rank(F.col("_chars"), F.col("_id"))).alias("_best"), F.count("*").alias("_size"))
    whole = salted.groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    groups = whole.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    groups = stage(groups, "op8")
    total, rivals = groups.agg(F.sum("_size"), F.max("_texts")).first()
    out = rows.select(*inner.columns, "_id", "_digest", sha.alias("text_sha256"), *["_norm"] * bool((rivals or 0) > 1))
    hot = F.col("_size") >= F.lit(max(1000, (total or 0) // HOT_KEYS + 1))
    found = lookup(out, "_digest", groups.select("_digest", "_texts", "_best", "_size"), "_digest", hot)
    if (rivals or 0) > 1:  # different texts under one digest: their members are found by content
        other = whole.select(F.col("_digest").alias("_d"), F.col("_norm").alias("_n"), F.col("_best").alias("_b"), F.col("_size").alias("_s"))
        found = found.join(other, (F.col("_texts") > 1) & (F.col("_digest") == F.col("_d")) & (F.col("_norm") == F.col("_n")), "left")
        found = found.withColumns({"_best": F.coalesce("_b", "_best"), "_size": F.coalesce("_s", "_size")})
    keep = _key_of(F.col("_best"))
    return found.select(*inner.columns, "_id", keep.alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 16, digest=None) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after removal of ASCII white space; null is
    empty, and all empty texts are one group.  The row with the most code points
    stays, then the smallest key (null keys last).  Rows that repeat the staying
    row's key share its verdict.  An empty table gives an empty result; other
    columns are never read.  digest (tests only) replaces SHA-256 in grouping.
    """
    found = _marked(docs.select(key, text), text, key, salts, digest)
    return found.select(F.col("_id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 16) -> DataFrame:
    """The documents that stay, with all their columns; the cases are those of mark_copies."""
    found = _marked(docs, text, key, salts, None)
    return found.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
