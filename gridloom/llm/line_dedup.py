"""Reversible line dedup: sharded cuckoo filters over exact reference tables.

State, all in the shared folder:

* references (key, doc): which documents hold a line, exact, one row per pair;
* counts (key, refs, last): documents per line and the largest of them;
* filters (shard, cuckoo): per key shard a cuckoo filter of the lines that
  enough documents hold.

Inserting or deleting documents adds what changes to these tables: pairs or the
keys of documents that are gone, new counts of the lines concerned, and the
filters of their shards, into which lines that reach the limit are inserted and
from which lines that fall below it are deleted.  Tables are rewritten whole
after every COMPACT changes only.  A document's lines are put to the filters first, and only what they
may hold is looked up in the exact counts, so a filter's false positives never
decide.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, WHITE, lookup, stage

SHARD_KEYS, GROUP_ROWS, COMPACT = 200_000, 200_000, 8
_REFS = "key binary, doc bigint"


class CuckooFilter:
    """Set of 128-bit digests with 16-bit fingerprints, four to a bucket; grows by further tables."""

    def __init__(self, expected: int = 64):
        self.tables = [self._table(expected)]

    @staticmethod
    def _table(expected: int):
        import numpy as np

        return np.zeros((1 << max(4, int(expected / 3).bit_length()), 4), np.uint16)

    @staticmethod
    def _parts(digests, table):
        import numpy as np

        words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        print_ = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        mask = np.uint64(len(table) - 1)
        one = words[:, 1] & mask
        two = one ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995C6A4A793)) >> np.uint64(20)) & mask
        return print_, one.astype(np.int64), two.astype(np.int64)

    def insert(self, digests: list[bytes]) -> None:
        """Digests must be new to the filter; references are counted elsewhere."""
        import numpy as np

        if not digests:
            return
        left = np.arange(len(digests))
        while len(left):
            table = self.tables[-1]
            prints, one, two = self._parts([digests[i] for i in left], table)
            todo = np.arange(len(left))
            for bucket in (one, two):
                for _ in range(4):
                    free = table[bucket[todo]] == 0
                    can = free.any(1)
                    slot = free.argmax(1)
                    at = bucket[todo] * 4 + slot
                    at[~can] = -1 - np.arange((~can).sum())
                    _, first = np.unique(at, return_index=True)
                    first = first[can[first]]
                    table.reshape(-1)[at[first]] = prints[todo[first]]
                    todo = np.delete(todo, first)
            stuck = [i for i in todo.tolist() if not self._kick(table, int(prints[i]), int(one[i]), int(two[i]))]
            left = left[np.array(stuck, np.int64)]
            if len(left):
                self.tables.append(self._table(4 * max(len(left), len(table))))

    @staticmethod
    def _kick(table, print_: int, one: int, two: int, tries: int = 200) -> bool:
        mask, undo, bucket = len(table) - 1, [], two
        for k in range(tries):
            row = table[bucket]
            for slot in range(4):
                if not row[slot]:
                    row[slot] = print_
                    return True
            slot = k % 4
            undo.append((bucket, slot, int(row[slot])))
            row[slot], print_ = print_, int(row[slot])
            bucket ^= (print_ * 0x5BD1E995C6A4A793 % 2**64) >> 20 & mask
        for bucket, slot, old in reversed(undo):
            table[bucket][slot] = old
        return False

    def contains(self, digests: list[bytes]):
        import numpy as np

        found = np.zeros(len(digests), bool)
        if digests:
            for table in self.tables:
                prints, one, two = self._parts(digests, table)
                found |= (table[one] == prints[:, None]).any(1) | (table[two] == prints[:, None]).any(1)
        return found

    def delete(self, digests: list[bytes]) -> None:
        """Digests must have been inserted."""
        for digest in digests:
            for table in reversed(self.tables):
                prints, one, two = self._parts([digest], table)
                for bucket in (int(one[0]), int(two[0])):
                    slots = (table[bucket] == prints[0]).nonzero()[0]
                    if len(slots):
                        table[bucket][slots[0]] = 0
                        break
                else:
                    continue
                break
            else:
                raise KeyError("the digest is not in the filter")

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.tables)) + b"".join(struct.pack("<I", len(t)) + t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        import numpy as np

        out, at = cls.__new__(cls), 4
        out.tables = []
        for _ in range(struct.unpack_from("<I", data)[0]):
            (n,) = struct.unpack_from("<I", data, at)
            out.tables.append(np.frombuffer(data, np.uint16, n * 4, at + 4).reshape(n, 4).copy())
            at += 4 + n * 8
        return out


def line_key(line: str, least: int) -> bytes | None:
    """Digest of a line's key, or None if the key is shorter than least code points."""
    bare = line.strip(WHITE)
    return hashlib.blake2b(bare.encode().lower(), digest_size=16).digest() if len(bare) >= least else None


def references(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 20) -> DataFrame:
    """Distinct (key, doc) pairs of the lines that are long enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, owners = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for line in (t.as_py() or "").split("\n") if (k := line_key(line, least))}
                keys += found
                owners += [doc] * len(found)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc"])

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, _REFS).distinct()


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


@dataclass
class LineIndex:
    """The lines of a set of documents; insert and delete return the index after the change."""

    spark: SparkSession
    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 3
    least: int = 20
    changes: int = 0

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 3, least: int = 20, shard_keys: int = SHARD_KEYS) -> LineIndex:
        refs = stage(references(docs, text, key, least), "op3-refs")
        counts = cls._count(refs)
        shards = max(1, -(-counts.where(F.col("refs") >= min_docs).count() // shard_keys))
        empty = docs.sparkSession.createDataFrame([], "shard int, cuckoo binary")
        index = cls(docs.sparkSession, refs, counts, empty, shards, min_docs, least)
        index.filters = index._update(counts.where(F.col("refs") >= min_docs).select("key", F.lit(True).alias("add")))
        return index

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return stage(refs.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc").alias("last")), "op3-counts")

    def _update(self, changes: DataFrame) -> DataFrame:
        """The filters of the shards that changes (key, add) concern, after them."""

        def run(pdf, old):
            import pandas as pd

            if pdf.empty and old.empty:
                return pd.DataFrame({"shard": [], "cuckoo": []})
            shard = int((old if pdf.empty else pdf)["shard"].iloc[0])
            cuckoo = CuckooFilter(len(pdf)) if old.empty else CuckooFilter.from_bytes(old["cuckoo"].iloc[0])
            cuckoo.delete(sorted(pdf["key"][~pdf["add"].astype(bool)]))
            cuckoo.insert(sorted(pdf["key"][pdf["add"].astype(bool)]))
            return pd.DataFrame({"shard": [shard], "cuckoo": [cuckoo.to_bytes()]})

        changes = changes.withColumn("shard", _shard(self.shards))
        concerned = self.filters.join(changes.select(F.col("shard").alias("_s")).distinct(), F.col("shard") == F.col("_s"), "left_semi")
        out = changes.groupBy("shard").cogroup(concerned.groupBy("shard")).applyInPandas(run, "shard int, cuckoo binary")
        return stage(out, "op3-filters")

    def _changed(self, refs: DataFrame, keys: DataFrame, counts: DataFrame) -> LineIndex:
        """The index with new references, in which the lines in keys have the counts given (none: no references are left)."""
        counts, key = stage(counts, "op3-counts"), keys.select(F.col("key").alias("_k"))
        before = self.counts.join(key, F.col("key") == F.col("_k"), "left_semi")
        was, now = (c.where(F.col("refs") >= self.min_docs).select("key") for c in (before, counts))
        changes = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).union(was.join(now, "key", "left_anti").withColumn("add", F.lit(False)))
        filters = self._update(changes)
        shards = filters.select(F.col("shard").alias("_s"))
        tables = [refs, self.counts.join(key, F.col("key") == F.col("_k"), "left_anti").union(counts), self.filters.join(shards, F.col("shard") == F.col("_s"), "left_anti").union(filters)]
        if whole := (self.changes + 1) % COMPACT == 0:
            tables = [stage(t, f"op3-{tag}") for t, tag in zip(tables, ("refs", "counts", "filters"), strict=True)]
        return LineIndex(self.spark, *tables, self.shards, self.min_docs, self.least, 0 if whole else self.changes + 1)

    def insert(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineIndex:
        """Add documents; pairs that are there already change nothing.  Shuffles what the documents bring, and the counts of their lines."""
        found = stage(references(docs, text, key, self.least), "op3-new")
        owner = found.select(F.col("doc").alias("_d")).distinct()
        held = self.references.join(owner, F.col("doc").eqNullSafe(F.col("_d")), "left_semi").toDF("_k", "_o")
        fresh = stage(found.join(held, (F.col("key") == F.col("_k")) & F.col("doc").eqNullSafe(F.col("_o")), "left_anti"), "op3-refs")
        more = fresh.groupBy("key").agg(F.count("*").alias("_n"), F.max("doc").alias("_last"))
        counts = more.join(self.counts, "key", "left").select("key", (F.coalesce("refs", F.lit(0)) + F.col("_n")).alias("refs"), F.greatest("last", "_last").alias("last"))
        return self._changed(self.references.union(fresh), fresh.select("key").distinct(), counts)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Remove the documents in the first column of ids, as if they had never been inserted.  Shuffles the references of their lines."""
        gone = stage(ids.select(F.col(ids.columns[0]).cast("bigint").alias("_gone")).distinct(), "op3-gone")
        on = F.col("doc").eqNullSafe(F.col("_gone"))
        keys = stage(self.references.join(gone, on, "left_semi").select("key").distinct(), "op3-keys")
        left = self.references.join(gone, on, "left_anti")
        counts = left.join(keys.toDF("_k"), F.col("key") == F.col("_k"), "left_semi").groupBy("key").agg(F.count("*").alias("refs"), F.max("doc").alias("last"))
        return self._changed(left, keys, counts)

    def losses(self) -> DataFrame:
        """(doc, keys): the line keys that each indexed document loses, for documents that lose any."""
        sizes = self.references.groupBy(_shard(self.shards).alias("shard")).count()
        salts = max(1, -(-(sizes.agg(F.max("count")).first()[0] or 0) // GROUP_ROWS))

        def probe(pdf, cuckoo):
            if pdf.empty or cuckoo.empty:
                return pdf[["key", "doc"]].iloc[:0]
            return pdf[["key", "doc"]][CuckooFilter.from_bytes(cuckoo["cuckoo"].iloc[0]).contains(pdf["key"].tolist())]

        dealt = self.references.withColumns({"shard": _shard(self.shards), "salt": F.pmod(F.xxhash64("doc", "key"), F.lit(salts)).cast("int")})
        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        maybe = stage(dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, _REFS), "op3-maybe")
        exact = self.counts.where(F.col("refs") >= self.min_docs).select(F.hex("key").alias("k"), "refs", "last")
        hot = F.col("refs") >= F.lit(max(1000, maybe.count() // HOT_KEYS + 1))
        found = lookup(maybe.withColumn("hex", F.hex("key")), "hex", exact, "k", hot)
        return found.where(F.col("refs").isNotNull() & ~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc").agg(F.collect_set("key").alias("keys"))


def rewrite(docs: DataFrame, losses: DataFrame, text: str = "text", key: str = "doc_id", least: int = 20) -> DataFrame:
    """docs with text rewritten, and with n_lines (before) and n_dropped added; texts that lose nothing stay as they are."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    joined = inner.join(losses.select(F.col("doc").alias("_doc"), F.col("keys").alias("_keys")), F.col(k).cast("bigint").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields) + ", n_lines bigint, n_dropped bigint"
    at = inner.columns.index(t)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, lines, dropped = [], [], []
            for value, keys in zip(batch.column(at), batch.column(len(inner_names)), strict=True):
                value = value.as_py()
                parts = (value or "").split("\n")
                lines.append(len(parts))
                if keys.is_valid:
                    lost = set(keys.as_py())
                    kept = [x for x in parts if line_key(x, least) not in lost]
                    dropped.append(len(parts) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(value)
            columns = list(batch.columns[: len(inner_names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*inner_names, "n_lines", "n_dropped"])

    inner_names = list(inner.columns)
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 3, least: int = 20) -> DataFrame:
    r"""Documents without the lines that min_docs documents share, but for the largest key that holds each.

    Texts are split at \n; a null or empty text is one empty line.  Documents
    are told apart by key alone: rows with one key count once and lose the same
    lines.  A null key is a document smaller than all.  Adds n_lines (before)
    and n_dropped, replacing columns of those names.  An empty table gives an
    empty result.
    """
    index = LineIndex.build(docs, text, key, min_docs, least)
    return rewrite(docs, index.losses(), text, key, least)
