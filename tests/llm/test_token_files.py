import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import token_files
from gridloom.llm.common import new_folder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def wanted(rows, tokenizer):
    """(key, start, ids) in the order of the files."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]).tobytes()
        out.append((key, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("shard_bytes", [token_files.SHARD_BYTES, 5_000])
def test_round_trip(docs, rows, tokenizer, shard_bytes):
    found = token_files.write_and_read(docs, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, found)) == [x[:4] for x in wanted([r[:2] for r in rows], tokenizer)]


def test_ids_and_shuffled_reads(spark, docs, rows, tokenizer):
    shards = token_files.write(docs, new_folder(spark, "test"), shard_bytes=30_000)
    assert shards.count() > 1
    ids = {x[0]: x[4] for x in wanted([r[:2] for r in rows], tokenizer)}
    assert {r.id: bytes(r.ids) for r in token_files.read(spark, shards).collect()} == ids
    places = []
    for s in shards.collect():
        width, index = token_files.read_index(s.path)
        assert width == 2 and len(index) == s.n_docs
        places += [(s.path, width, e) for e in index]
    random.Random(4).shuffle(places)
    for path, width, e in places[:40]:
        assert token_files.read_record(path, int(e["offset"]), width).tobytes() == ids[int(e["key"])]


def test_repeated_rows_null_keys_and_clashing_names(odd, tokenizer):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted(map(tuple, token_files.write_and_read(odd).collect()), key=lambda r: r[1])
    assert found == [x[:4] for x in wanted(rows, tokenizer)]


def test_stores_by_their_hadoop_names(tmp_path):
    for uri in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        fs, path = token_files._store(uri)
        assert fs.type_name == "local" and path == str(tmp_path)
    with pytest.raises(ValueError, match="does not know this store"):
        token_files._store("nosuchstore://x/y")


def test_frames_guard_their_bytes():
    import io

    data = token_files.frame(b"abcdef") + token_files.frame(b"")
    stream = io.BytesIO(data)
    assert token_files.unframe(stream) == b"abcdef" and token_files.unframe(stream) == b""
    for k in range(12 + 6 + 4):
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            token_files.unframe(io.BytesIO(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 : 22]))
    assert token_files.masked(b"123456789") == ((0xCBF43926 >> 15 | 0xCBF43926 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_empty(nothing):
    assert token_files.write_and_read(nothing).count() == 0
