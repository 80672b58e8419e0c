"""The registered queries: DuckDB statements, contracts against brute force, and the pipeline."""

import os
import random

import duckdb
import public_tokenizers
import pytest
import test_embedding_dedup
import test_packing
import test_suffix_dedup
import test_token_files
from test_line_dedup import brute as brute_lines
from test_mixing import brute_targets, words
from test_simhash import brute as brute_simhash

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from gridloom.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(row):
    return tuple(f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found) and {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.SQL)
def test_sql_gives_the_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    wanted = duck.execute(f"select {', '.join(names)} from ({queries.SQL[name]})").fetchall()
    assert sorted(plain(r[n] for n in names) for r in df.collect()) == sorted(map(plain, wanted))


#: What each contract returns, by type.
COLUMNS = {
    "op1": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4": "doc_id bigint, fingerprint string, component_id bigint",
    "op5": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_one_row_for_each_input_row(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    n = name.split("_")[0]
    assert dict(df.dtypes).items() >= {tuple(x.split()) for x in COLUMNS[n].split(", ")}
    table = {"op6": "embeddings", "op10": "pages"}.get(n, "documents")
    assert (df.where("piece = 0") if n == "op2" else df).count() == duck.execute(f"select count(*) from {table}").fetchone()[0]


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents").fetchall()


def vocabulary(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_op2_packs_every_piece(spark, texts):
    found = queries.op2_best_fit_packing(spark, DIR).collect()
    assert test_packing.shown(found) == test_packing.wanted(texts, vocabulary("word_bpe_49k.json"), 2048)
    assert test_packing.check(found, 2048) <= -(-sum(r.length for r in found) // 2048) + 1


def test_op4_equals_brute_force(spark, texts):
    assert sorted(map(tuple, queries.op4_simhash(spark, DIR).collect()), key=repr) == brute_simhash(texts)


def test_op5_equals_whole_text_calls(spark, texts):
    assert sorted(map(tuple, queries.op5_token_files(spark, DIR).collect())) == [x[:4] for x in test_token_files.wanted(texts, vocabulary("byte_bpe_50k.json"))]


def test_op6_recall(spark, duck):
    truth = test_embedding_dedup.brute(duck.execute("select vec_id, embedding, label from embeddings").fetchall())
    found = test_embedding_dedup.shown(queries.op6_embedding_dedup(spark, DIR))
    assert set(found) == set(truth) and all(found[k][0] <= truth[k][0] for k in truth)
    assert sum(x[0] for x in found.values()) >= 0.9 * sum(x[0] for x in truth.values())


def test_op7_equals_brute_force(spark, texts):
    assert test_suffix_dedup.shown(queries.op7_suffix_dedup(spark, DIR)) == test_suffix_dedup.brute(texts)


def test_op9_held_out_accuracy(spark, duck):
    truth = dict(duck.execute("select doc_id, lang from documents where lang is not null").fetchall())
    held = [r for r in queries.op9_language_id(spark, DIR).collect() if r.held_out and r.lang_pred != "und" and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def strange_texts():
    """Longer texts in no language of the tables."""
    rng = random.Random(2)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(90)) for letters in ("bdfgjkmpqvwxyz", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436") * 3]


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it kept; the near-copy stage follows the general rule of five words and a similarity of 0.8."""
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    strange = [(900_000 + k, t, None, "src0", len(t)) for k, t in enumerate(strange_texts())]
    docs = documents.unionByName(spark.createDataFrame(strange, documents.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    outs = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, columns = docs.collect(), docs.columns
        docs = function(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        outs.append((name, before, docs.collect()))
    for name, before, after in outs:
        if name == "language_id":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if r.doc_id < 900_000 and r.text and any(map(str.isalpha, r.text))}
        elif name == "line_dedup":
            assert sorted((r.doc_id, r.text) for r in after) == sorted((k, t) for k, _, _, t in brute_lines([(r.doc_id, r.text) for r in before]))
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_dedup":
            firsts = {k for k, c in brute_jaccard([(r.doc_id, r.text) for r in before]).items() if k == c}
            assert {r.doc_id for r in after} == firsts and len(after) == len(firsts) < len(before)
        else:
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
            targets = brute_targets(sizes)
            for r in before:
                times, rate = sum(x.doc_id == r.doc_id for x in after), targets[r.source] / sizes[r.source] if sizes[r.source] else 0
                assert int(rate) <= times <= int(rate) + 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert test_packing.shown(packed) == test_packing.wanted([(r.doc_id, r.text) for r in docs.collect()], vocabulary("word_bpe_49k.json"), 2048)
    test_packing.check(packed, 2048)


def brute_jaccard(rows):
    """{key: least key reachable} over pairs of texts with a 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


@pytest.mark.parametrize(("name", "function"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, nothing, name, function):
    """Null keys, texts, sources and labels, repeated rows, long texts, and columns that clash; then an empty table."""
    out = function(spark, odd, DIR)
    found = out.collect()
    assert function(spark, nothing, DIR).count() == 0
    if name == "pack":
        assert sum(r.piece == 0 for r in found) == odd.count()
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    kept = [c for c in odd.columns if c not in ("text", "lang", "n_chars")]
    rows = {repr([r[c] for c in kept]) for r in odd.collect()}
    assert found and {repr([r[c] for c in kept]) for r in found} <= rows


def test_stages_need_no_further_columns(spark):
    docs = spark.createDataFrame([(k, f"a line that is shared by all of them\nits own words number {k}", None, "s") for k in range(6)], "doc_id bigint, text string, lang string, source string")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()


def test_pipeline_runs_whole(spark):
    found = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "sequence_id", "offset"} <= set(found.columns)
    test_packing.check(found.collect(), 2048)
