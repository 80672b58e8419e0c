import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import components


def slow_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, distance=3):
    """{row number: smallest key reachable} for (key, fingerprint) rows."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(pairs):
        r = find(i)
        if key is not None and (least.get(r) is None or key < least[r]):
            least[r] = key
    return [least.get(find(i)) for i in range(len(pairs))]


def brute(rows):
    pairs = [(k, slow_fingerprint(t)) for k, t in rows]
    return sorted(((k, f"{fp:016x}", c) for (k, fp), c in zip(pairs, brute_components(pairs), strict=True)), key=repr)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_matches_brute_force(docs, rows):
    assert shown(simhash.near_copies(docs)) == brute([r[:2] for r in rows])


def test_repeated_rows_null_keys_and_clashing_names(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert shown(simhash.near_copies(odd)) == brute(rows)
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    firsts = {c for _, _, c in brute(rows)}
    assert sorted(repr(r) for r in kept.collect()) == sorted(repr(r) for r in odd.collect() if r.doc_id is None or r.doc_id in firsts)


def planted(n, near, bits=64, seed=3):
    rng = random.Random(seed)
    out = [rng.getrandbits(bits) for _ in range(n)]
    for _ in range(near):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize(("choices", "bucket_rows"), [((2,), 20_000), ((3,), 20_000), ((4,), 20_000), ((2, 3, 4), 20_000), ((4,), 30), ((2, 3), 20)])
def test_every_link_is_found_at_any_plan_and_bucket_size(spark, choices, bucket_rows):
    fps = sorted(set(planted(250, 250) + planted(60, 0, 10)))
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(df, 3, bucket_rows, choices)).collect()}
    groups = {}
    for k, f in enumerate(fps):
        s = f - (f >> 63 << 64)
        groups.setdefault(found.get(s, s), set()).add(k)
    wanted = {}
    for k, c in enumerate(brute_components(list(enumerate(fps)))):
        wanted.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_thresholds_spend_the_distance():
    cost = [[0.0, 9.0, 30.0], [0.0, 1.0, 2.0], [0.0, 4.0, 50.0]]
    chosen = simhash.allocate(cost, 1)
    assert sum(chosen) == 1
    import itertools

    best = min(sum(row[t + 1] for row, t in zip(cost, ts, strict=True)) for ts in itertools.product((-1, 0, 1), repeat=3) if sum(ts) == 1)
    assert sum(row[t + 1] for row, t in zip(cost, chosen, strict=True)) == best


def test_correlated_bits_share_a_partition():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, 64))
    for b in range(8):
        x[:, 8 + b] = x[:, 40]  # nine bits that are always equal
    together = (x.T @ x).astype(float)
    groups = simhash.correlated_partitions(together, len(x), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({8, 9, 10, 11, 12, 13, 14, 15, 40} <= set(g) for g in groups)


def test_large_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one text for most of the rows here")).otherwise(F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    out = simhash.near_copies(df)
    assert out.where("doc_id % 3 > 0").select("component_id").distinct().count() == 1


@pytest.mark.parametrize("plain", [0, 200_000])
def test_components_with_hot_nodes(spark, monkeypatch, plain):
    """Beyond so many rows, nodes with a thousand neighbours and more are looked up by broadcast."""
    monkeypatch.setattr("gridloom.llm.common.PLAIN_ROWS", plain)
    edges = [(0, k) for k in range(1, 2500)] + [(k, k + 5000) for k in range(1, 2500)] + [(9001, 9000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {k: 0 for k in [*range(2500), *range(5001, 7500)]} | {9000: 9000, 9001: 9000}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(-5, -5), (3000, 2999), (2999, 3000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} | {2999: 2999, 3000: 2999}


def test_empty(nothing):
    assert simhash.near_copies(nothing).count() == 0 and simhash.drop_near_copies(nothing).count() == 0
