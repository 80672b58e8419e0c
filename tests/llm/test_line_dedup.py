import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup
from gridloom.llm.line_dedup import CuckooFilter, LineIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows):
    """(key, lines, dropped, text) for rows (key, text); None sorts below all keys."""
    held = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 20:
                held[line_key(line)].add(key)
    last = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in held.items() if len(d) >= 3}
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(line_key(x), key) == key]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_matches_brute_force(docs, rows):
    found = shown(line_dedup.dedup_lines(docs))
    assert found == brute([r[:2] for r in rows]) and sum(r[2] for r in found) > 10


def test_repeated_rows_null_keys_and_clashing_names(odd):
    out = line_dedup.dedup_lines(odd)
    assert shown(out) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in odd.columns if c not in ("n_lines", "n_dropped")]
    same = [c for c in odd.columns if c not in ("n_lines", "n_dropped", "text")]
    assert sorted(map(repr, out.select(same).collect())) == sorted(map(repr, odd.select(same).collect()))


def test_insert_and_delete_are_reversible(docs, rows):
    first = docs.where("doc_id < 100")
    index = LineIndex.build(first, shard_keys=2)
    whole = index.insert(docs.where("doc_id >= 100"))
    assert whole.shards > 1
    assert shown(line_dedup.rewrite(docs, whole.losses())) == brute([r[:2] for r in rows])
    back = whole.delete(docs.where("doc_id >= 100").select("doc_id"))
    for table in ("references", "counts"):
        assert sorted(map(repr, getattr(back, table).collect())) == sorted(map(repr, getattr(index, table).collect()))
    assert shown(line_dedup.rewrite(first, back.losses())) == brute([r[:2] for r in rows if r[0] < 100])
    live = {bytes(r.key) for r in back.counts.where("refs >= 3").collect()}
    gone = {bytes(r.key) for r in whole.counts.where("refs >= 3").collect()} - live
    filters = [CuckooFilter.from_bytes(bytes(r.cuckoo)) for r in back.filters.collect()]
    assert all(any(f.contains([k])[0] for f in filters) for k in live)
    assert sum(any(f.contains([k])[0] for f in filters) for k in gone) <= len(gone) // 100
    again = back.insert(docs.where("doc_id >= 100")).insert(docs)  # what is there already changes nothing
    assert sorted(map(repr, again.counts.collect())) == sorted(map(repr, whole.counts.collect()))


def test_many_changes_end_where_one_build_does(spark, docs, rows, monkeypatch):
    """Inserts and deletes in turn, across a compaction, give the tables of an index built at once."""
    monkeypatch.setattr(line_dedup, "COMPACT", 3)
    index = LineIndex.build(docs.where("doc_id < 0"), shard_keys=2)
    index = index.insert(docs.where("doc_id between 0 and 99")).insert(docs.where("doc_id >= 100"))
    index = index.delete(spark.createDataFrame([(x,) for x in (1, 4, 604, 10**9)], "doc_id bigint")).delete(docs.where("doc_id > 500").select("doc_id"))
    index = index.insert(docs.where("doc_id >= 500 or doc_id in (1, 4)"))
    kept, built = index, LineIndex.build(docs, shard_keys=2)
    assert kept.changes < 3
    for table in ("references", "counts"):
        assert sorted(map(repr, getattr(kept, table).collect())) == sorted(map(repr, getattr(built, table).collect()))
    assert shown(line_dedup.rewrite(docs, kept.losses())) == brute([r[:2] for r in rows])
    only = kept.filters.groupBy("shard").count().where("count > 1").count()
    assert only == 0  # one filter a shard


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.randbytes(16) for _ in range(6000)]
    f = CuckooFilter(500)  # grows twice and more
    f.insert(keys[:3000])
    f.insert(keys[3000:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[1000:4000])
    assert f.contains(keys[:1000]).all() and f.contains(keys[1000:4000]).mean() < 0.01
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(keys[:1000]).all() and again.contains([]).tolist() == []
    with pytest.raises(KeyError):
        CuckooFilter().delete(keys[:1])


def test_one_line_in_every_document(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("the one and only common line\n"), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    out = line_dedup.dedup_lines(df).where("n_dropped = 0").collect()
    assert [r.doc_id for r in out] == [4999]


def test_empty(nothing):
    out = line_dedup.dedup_lines(nothing)
    assert out.count() == 0 and out.columns == [*nothing.columns, "n_lines", "n_dropped"]
