"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, WORD, lookup, stage

#: Targets are broadcast as far as their sources take so many bytes, and joined by a shuffle beyond that.
BROADCAST_BYTES = 20_000_000


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Rows (source, source_size, ...) with the target added, one row per source.

    Sources by code point, null last, take the weights in turn.  The targets sum
    to share times all sizes; none is above most times its source's size, and
    what a source can't take is reshared by weight.  Every source below its
    limit has the same target per weight, so the sources at their limit are a
    prefix in the order of limit per weight.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    by_room = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    over_all = Window.partitionBy()
    s = sizes.withColumns({"weight": weight, "cap": F.col("source_size") * most})
    s = s.withColumns({"all_size": F.sum("source_size").over(over_all), "all_weight": F.sum("weight").over(over_all)})
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(by_room), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(by_room), F.lit(0))})
    budget = F.col("all_size") * F.lit(float(share))
    full = (budget - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("full", full)
    s = s.withColumns({"used": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(over_all), "used_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(over_all)})
    part = (budget - F.col("used")) * F.col("weight") / F.nullif(F.col("all_weight") - F.col("used_weight"), F.lit(0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), part))
    return s.select(*sizes.columns, target.alias("target"))


def plan_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix", **weights) -> DataFrame:
    """docs with size, source_size, target and copies added (any columns so named are replaced).

    A document of a source with repetition rate r = target / size gets floor(r)
    copies and one more if the number drawn from MD5 of seed and key is below the
    fraction, so reruns agree and rows with one key share a draw.  Null text has
    size 0, null keys and null sources are ordinary values, and a source without
    words has target 0.  An empty table gives an empty result.
    """
    added = ("size", "source_size", "target", "copies")
    inner = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    d = docs.toDF(*inner.values())
    own_key, own_source = F.col(inner[key]), F.col(inner[source])
    of_source = F.coalesce(F.concat(F.lit("s"), own_source.cast("string")), F.lit("n"))
    d = d.withColumns({"size": F.coalesce(F.regexp_count(F.col(inner[text]), F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")), "of_source": of_source})
    sums = d.groupBy("of_source", own_source.alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = stage(source_targets(sums, **weights), "op1").select(F.col("of_source").alias("to"), "source_size", "target", "rows")
    size, total = targets.agg(F.sum(F.octet_length("to") + 40), F.sum("rows")).first()
    if (size or 0) <= BROADCAST_BYTES:
        d = d.join(F.broadcast(targets), F.col("of_source") == F.col("to"), "left")
    else:
        d = lookup(d, "of_source", targets, "to", F.col("rows") >= F.lit(total // HOT_KEYS + 1))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own_key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    d = d.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("int"))
    return d.select(*[F.col(k).alias(c) for c, k in inner.items() if c not in added], *added)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as planned, with its own columns."""
    inner = {c: f"m{k}" for k, c in enumerate(docs.columns)}
    names = {n: inner[options.pop(n, c)] for n, c in (("text", "text"), ("key", "doc_id"), ("source", "source"))}
    planned = plan_copies(docs.toDF(*inner.values()), **names, **options)
    times = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    return planned.withColumn("turn", times).select(*[F.col(k).alias(c) for c, k in inner.items()])
