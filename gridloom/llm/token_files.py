"""Token ids in length-delimited binary records, with an offset index beside each file.

A shard is two files.  NAME.rec holds one record per document, in key order:

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload

all little-endian; the payload is the ids, each of the width that the index
header names.  NAME.idx starts with 16 bytes (b"GLIDX1", u16 bytes per id, u64
records) and has a 32-byte entry per record: i64 key, u64 has key, u64 offset of
the record, u64 ids.  A reader can thus fetch records in any order.  The masked
checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder, stage

SHARD_BYTES = 24_000_000
_ENTRY, _HEAD, _MAGIC = "<qQQQ", "<6sHQ", b"GLIDX1"
_SHARDS = "shard bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> bytes:
    """The next payload of a stream; raises ValueError where a checksum does not hold."""
    head = stream.read(12)
    size, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    payload = stream.read(size)
    if len(payload) != size or struct.unpack("<I", stream.read(4))[0] != masked(payload):
        raise ValueError("a record is damaged")
    return payload


#: Hadoop's names of stores that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _store(uri: str):
    """Arrow's file system and path of a Hadoop URI or a plain path; ValueError names stores that Arrow can't reach."""
    from pyarrow.fs import FileSystem

    scheme, sep, rest = uri.partition("://")
    known = f"{_SCHEMES.get(scheme, scheme)}{sep}{rest}"
    try:
        return FileSystem.from_uri(f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not sep else known)
    except Exception as e:
        raise ValueError(f"{uri}: token files are written through Arrow, which does not know this store") from e


def _publish(fs, folder: str, name: str, temporary: str) -> None:
    """Move a finished file into place; a second attempt of a task replaces the first one's equal file."""
    from pyarrow.fs import FileType

    if fs.type_name != "local" and fs.get_file_info(f"{folder}/{name}").type != FileType.NotFound:
        fs.delete_file(f"{folder}/{name}")
    fs.move(temporary, f"{folder}/{name}")


def write(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents in ascending key order below folder (a URI of a store that Arrow reaches); returns one row per shard.

    Null and empty texts are the end id alone; null keys come last; rows with
    equal keys are ordered by text.  An empty table writes no files.
    """
    tokenizer = tokenizer or tokens.default_path("byte_bpe_50k.json")
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    by = F.col("_id").asc_nulls_last()
    rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), by).sortWithinPartitions(by, "_text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, encode, end = TaskContext.get().partitionId(), tokens.encoder(tokenizer), end_id.to_bytes(4, "little")
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        fs, base = _store(folder)
        name, temporary = f"part-{shard:06d}", f"{base}/_{uuid.uuid4().hex}"
        out, entries, at, count = None, [], 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{temporary}.rec", buffer_size=1 << 20)
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                record = frame(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)
                out.write(record)
                entries.append(struct.pack(_ENTRY, k or 0, k is not None, at, n))
                at, count = at + len(record), count + n
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{temporary}.idx") as index:
            index.write(struct.pack(_HEAD, _MAGIC, width, len(entries)) + b"".join(entries))
        _publish(fs, base, f"{name}.rec", f"{temporary}.rec")
        _publish(fs, base, f"{name}.idx", f"{temporary}.idx")
        yield pa.record_batch([pa.array([x]) for x in (shard, f"{folder}/{name}", len(entries), count, at)], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    return stage(rows.mapInArrow(run, _SHARDS), "op5-shards")


def read_index(path: str):
    """Bytes per id and the entries (key, has key, offset, ids) of one shard, as a NumPy table."""
    import numpy as np

    fs, base = _store(f"{path}.idx")
    with fs.open_input_stream(base) as f:
        data = f.read()
    magic, width, n = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or len(data) != struct.calcsize(_HEAD) + n * struct.calcsize(_ENTRY):
        raise ValueError(f"{path}.idx is damaged")
    return width, np.frombuffer(data, [("key", "<i8"), ("has", "<u8"), ("offset", "<u8"), ("n", "<u8")], offset=struct.calcsize(_HEAD))


def read_record(path: str, offset: int, width: int):
    """The ids of the record at an offset, for shuffled reads."""
    import numpy as np

    fs, base = _store(f"{path}.rec")
    with fs.open_input_file(base) as f:
        f.seek(offset)
        return np.frombuffer(unframe(f), f"<u{width}").astype("<u4")


def read(spark: SparkSession, shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per record of the shards: id, start (ids before it), n_tokens, ids_crc32 and, unless unwanted, the ids (u32, packed)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = shards.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    placed = placed.repartition(max(1, shards.count()), "shard")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                width, index = read_index(path)
                fs, base = _store(f"{path}.rec")
                with fs.open_input_stream(base, buffer_size=1 << 20) as f:
                    for lo in range(0, len(index), 1000):
                        rows = ([], [], [], [], [])
                        for entry in index[lo : lo + 1000]:
                            ids = np.frombuffer(unframe(f), f"<u{width}").astype("<u4")
                            if len(ids) != entry["n"]:
                                raise ValueError(f"{path}.idx does not fit its records")
                            for column, value in zip(rows, (int(entry["key"]) if entry["has"] else None, start, len(ids), zlib.crc32(ids), ids.tobytes() if with_ids else None), strict=True):
                                column.append(value)
                            start += len(ids)
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def write_and_read(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Write to a new folder of the shared place and read back: key, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    shards = write(docs, new_folder(spark, "op5-records"), key=key, **options)
    return read(spark, shards, with_ids=False).select(F.col("id").alias(key), "start", "n_tokens", "ids_crc32")
