"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A piece goes where the sum, over residual gaps, of the squared number of open
bins with that gap becomes smallest; opening a bin is one of the choices.  Shards
of bounded size are packed on their own.  What stands in bins that the rule has
not filled is packed again, and then a bin is opened only where nothing has room,
so a shard leaves one bin at most that is no more than half full; those are
packed again as items, and so on until one shard holds them all.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stage

SHARD_PIECES = 40_000
_NOWHERE = 1 << 62
_PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_OPEN = "item bigint, bin bigint, offset bigint, filled bigint"


def sum_of_squares(sizes, capacity: int, opening: bool = True):
    """Bins and offsets of items in the given order: arrays (bin, offset, filled by bin).

    A new bin is one of the choices, with the sum that opening it would give;
    without opening, it is the choice only where no open bin has room.
    """
    import numpy as np

    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full and new bins are not counted
    bins: dict[int, list[int]] = {}
    where, offset, filled = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    gaps = np.arange(capacity + 1)
    for i, s in enumerate(map(int, sizes)):
        change = count[: capacity + 1 - s] - count[s:]  # half the change, for a bin with gap s, s + 1, ...
        change[0] = -count[s]
        at = np.where(count[s:] > 0, 2 * change + 2 - (gaps[s:] == s), _NOWHERE)
        if opening:
            at[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        k = int(at.argmin())
        if at[k] < _NOWHERE and k < capacity - s:
            gap = k + s
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(filled)
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += s
        if left := gap - s:
            count[left] += 1
            bins.setdefault(left, []).append(b)
    return where, offset, np.array(filled, np.int64)


def best_fit(sizes, capacity: int):
    """Bins and offsets as of sum_of_squares; what the rule leaves in bins that are not full is packed again without opening."""
    import numpy as np

    where, offset, filled = sum_of_squares(sizes, capacity)
    full = filled == capacity
    again = np.flatnonzero(~full[where])
    to, by, rest = sum_of_squares(np.asarray(sizes)[again], capacity, opening=False)
    where = (np.cumsum(full) - 1)[where]
    where[again], offset[again] = full.sum() + to, by
    return where, offset, np.concatenate([filled[full], rest])


def cut(docs: DataFrame, text: str, key: str, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most capacity ids: id, piece, start, length, ids_crc32."""
    import pyarrow as pa

    def run(batches):
        encode, end = tokens.encoder(tokenizer), end_id.to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            rows = ([], [], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def _round(items: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(item, bin, offset, filled) of items (item, size), dealt evenly over the shards."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        where, offset, filled = best_fit(pdf["size"].to_numpy(), capacity)
        base = int(pdf["shard"].iloc[0]) << 24
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "bin": base + where, "offset": offset, "filled": filled[where]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, _OPEN)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    A document is its ids and end_id; null and empty texts are end_id alone.
    Only documents longer than capacity are cut.  Rows with equal or null keys
    are packed one by one.  Sequences are filled from 0 without gaps.  An empty
    table gives an empty result; other columns are not read.
    """
    tokenizer = tokenizer or tokens.default_path("word_bpe_49k.json")
    pieces = stage(cut(docs, text, key, tokenizer, capacity, end_id), "op2")
    pieces = stage(pieces.withColumn("item", F.monotonically_increasing_id()), "op2")
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    left = short.count()
    shards = max(1, -(-left // shard_pieces))
    placed = stage(_round(short.select("item", F.col("length").alias("size")), shards, capacity), "op2")
    level, place = 0, placed.select("item", "bin", "offset")
    while shards > 1:
        # bins at most half full become items of the next round; a bin moves as one block
        level += 1
        room = placed.groupBy("bin").agg(F.first("filled").alias("size"))
        opened = room.where(F.col("size") * 2 <= capacity)
        shards = max(1, -(-opened.count() // shard_pieces))
        again = _round(opened.select(F.col("bin").alias("item"), "size"), shards, capacity)
        placed = stage(again.withColumn("bin", F.col("bin") + F.lit(level << 56)), "op2")
        moved = placed.select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        place = place.join(moved, "bin", "left").select("item", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
        place = stage(place, "op2")
    short = short.join(place, "item").withColumnRenamed("bin", "sequence_id")
    names = [F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(names).unionByName(short.select(names))
