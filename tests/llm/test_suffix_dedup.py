import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import suffix_dedup
from gridloom.llm.suffix_dedup import SuffixFamily, SuffixIndex


def brute(rows, length=50):
    """Rows (key, bytes, removed, runs, digest); rows of one key are parts of one document, None is the largest key."""
    big = 2**63 - 1
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            k = big if key is None else key
            first[s] = min(first.get(s, k), k)
    out = []
    for key, text in rows:
        data, k = (text or "").encode(), big if key is None else key
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(data)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_matches_brute_force(docs, rows):
    found = shown(suffix_dedup.drop_repeats(docs))
    assert found == brute([r[:2] for r in rows]) and sum(r[2] for r in found) > 1000


def test_repeated_rows_null_keys_and_clashing_names(odd):
    assert shown(suffix_dedup.drop_repeats(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "GROUP_ANCHORS", 50)
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé \n") for _ in range(1500))
    rows = []
    for k in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, 1400)
            text += base[at : at + rng.randint(20, 140)] if rng.random() < 0.7 else "".join(rng.choice("xyzé") for _ in range(rng.randint(1, 60)))
        rows.append((k - 30, text))
    rows += [(1000, "a" * 400), (1001, "a" * 49), (1002, "a" * 50), (1003, "b" + "a" * 60 + "b"), (1004, "ab" * 100), (1005, "ab" * 40), (1006, "\0" * 100), (1007, "x" + "\0" * 70), (1008, "\0" * 55 + "y\0\0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert shown(suffix_dedup.drop_repeats(df)) == brute(rows)


def test_strings_across_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(2000))
    rows = [(1, long), (2, "q" * 10 + long[250:1400] + "z"), (3, long[100:160] + "w" + long[1300:])]
    assert shown(suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_one_passage_in_every_document(spark):
    passage = "this passage of more than fifty bytes is found in every document"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(passage)).alias("text"))
    assert shown(suffix_dedup.drop_repeats(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_family_answers_as_a_dictionary_would():
    """Arrays in any order of documents: what is not lost in the end is what the least document of each string holds."""
    rng = np.random.default_rng(6)
    family, seen, lost, n, entries = SuffixFamily(20), {}, set(), 0, []
    for _ in range(12):
        strings, docs = rng.integers(0, 400, 150).astype("S20"), rng.integers(0, 60, 150)
        tags = n + np.arange(150)
        n += 150
        for s, d, t in zip(strings.tolist(), docs.tolist(), tags.tolist(), strict=True):
            seen[s] = min(seen.get(s, d), d)
            entries.append((s, d, t))
        gone = family.add(strings, docs, tags).tolist()
        assert not lost & set(gone) and len(set(gone)) == len(gone)
        lost |= set(gone)
        assert lost == {t for s, d, t in entries if d > seen[s]}
        for level, _, _ in family.levels:
            assert (level[1:] >= level[:-1]).all()
        assert all(d == seen[s] for level, first, _ in family.levels for s, d in zip(level.tolist(), first.tolist(), strict=True))
        sizes = [len(level).bit_length() for level, _, _ in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    assert sorted(family.all()[2].tolist()) == sorted({t for _, _, t in entries} - lost)


@pytest.mark.parametrize("length", [50, 24])
def test_batches_against_levels(spark, docs, rows, length):
    """Documents batch by batch: each batch is judged against all before it, whose levels are written tables."""
    index, parts = SuffixIndex.empty(spark, length, buckets=3), 7
    before, merged = [], False
    for k in range(parts):
        batch = [r for i, r in enumerate(rows) if i * parts // len(rows) == k]
        index, found = index.insert(spark.createDataFrame([r[:2] for r in batch], "doc_id bigint, text string").repartition(2))
        # earlier batches come first whatever their keys: brute force sees them under keys below all others
        wanted = brute([(-10_000 + i, t) for i, t in enumerate(before)] + [r[:2] for r in batch], length)
        assert shown(found) == [x for x in wanted if x[0] is None or x[0] > -5_000]
        before += [r[1] for r in batch]
        merged |= len(index.levels) <= k
        sizes = [n.bit_length() for _, n in index.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    assert merged


def test_one_phrase_in_all_documents_with_different_surroundings(spark, monkeypatch):
    """An anchor with many documents is dealt string by string; so is a passage that a third of them share."""
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", 40)
    phrase, passage = "0123456789abcdef", "a passage that one third of all documents hold word for word, and more"
    one = F.sha2(F.col("id").cast("string"), 256)
    two = F.sha2((F.col("id") % 50).cast("string"), 256)
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(one, F.lit(phrase), two, F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise(F.lit("")), one).alias("text"))
    assert len(hot_anchors(df)) > 0
    assert shown(suffix_dedup.drop_repeats(df.repartition(7))) == brute([(r.doc_id, r.text) for r in df.collect()])


def hot_anchors(df):
    rows = suffix_dedup._rows(df, "text", "doc_id")
    found = suffix_dedup._anchor_groups(rows, 50, 3, 2, 40)
    return [x for r in found.where("dest < 0").collect() for x in suffix_dedup.restored(r.a).tolist()]


def test_dealt_rows_do_not_grow_with_the_square_of_the_table():
    """What a task has settled stays in one row, whatever the number of buckets, and groups that meet are few at 6 GB."""
    run, n = suffix_dedup._Run(50), 400
    data = bytes(range(60)) * n
    at = 60 * np.arange(n)
    run.take(data, at, at, np.full(n, 7, np.uint64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
    rows = suffix_dedup._dealt_run(run, 300, np.empty(0, np.int64), None)
    assert [len(suffix_dedup.restored(r[3])) for r in rows if r[1] == 1] == [n - 1]
    texts, anchors, passages = (6e9 / x for x in (suffix_dedup.TEXT_BYTES, suffix_dedup.GROUP_BYTES, 17 * suffix_dedup.GROUP_ANCHORS))
    assert texts * passages < 1.5e6 and texts * anchors < 0.5e6


def test_open_anchors_are_settled_in_runs(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "OPEN", 3)
    for table, wanted in ((docs, rows), (spark.createDataFrame([(9 - k, f"{k:x}" * 40 + "0123456789abcdefghijklmnopqrstuvwxyz" * 2 + f"{k % 4}" * 40) for k in range(10)], "doc_id bigint, text string"), None)):
        assert shown(suffix_dedup.drop_repeats(table)) == brute([r[:2] for r in wanted or table.collect()])


def test_squeezed_arrays_come_back():
    for x in ([], [5], [-(2**63), 2**63 - 1, 0], [7, 7, 7], list(range(100_000))):
        assert suffix_dedup.restored(suffix_dedup.squeezed(np.array(x, np.int64))).tolist() == x


def test_runs_are_maximal():
    rng = np.random.default_rng(2)
    spans = [(int(k), int(a), int(a) + int(n)) for k, a, n in zip(rng.integers(0, 5, 300), rng.integers(0, 500, 300), rng.integers(1, 20, 300), strict=True)]
    (k,), lo, hi = suffix_dedup.runs([np.array([s[0] for s in spans])], np.array([s[1] for s in spans]), np.array([s[2] for s in spans]))
    wanted = [(key, *span) for key in range(5) for span in suffix_dedup.merge([s[1:] for s in spans if s[0] == key])]
    assert sorted(zip(k.tolist(), lo.tolist(), hi.tolist(), strict=True)) == wanted


def test_kept_bytes(docs):
    for r in suffix_dedup.drop_repeats(docs).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_empty(nothing):
    assert suffix_dedup.drop_repeats(nothing).count() == 0
