"""Queries that take whole operands, against NumPy."""

import os

import numpy as np
import pyarrow.parquet as pq

from gridloom import queries as engine

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def column(name, key, value):
    t = pq.read_table(f"{DIR}/{name}.parquet", columns=[key, value]).sort_by(key)
    return np.array(t[value].to_pylist(), float)


def dense(df):
    found = np.array(df.select("i0", "i1", "v").collect(), float)
    out = np.full(found[:, :2].max(0).astype(int) + 1, np.nan)
    out[found[:, 0].astype(int), found[:, 1].astype(int)] = found[:, 2]
    assert len(found) == out.size
    return out


def test_inner_takes_all_rows(spark):
    m = column("embeddings", "vec_id", "embedding")
    assert np.allclose(dense(engine.QUERIES["inner"](spark, DIR)), m.T @ m, rtol=0, atol=1e-6)


def test_outer_takes_all_rows(spark):
    m = column("embeddings", "vec_id", "embedding")
    assert np.allclose(dense(engine.QUERIES["outer"](spark, DIR)), np.outer(m.max(1), m.max(0)), rtol=0, atol=1e-4)


def test_broadcast_of_both_takes_all_rows(spark):
    m = column("embeddings", "vec_id", "embedding")
    assert np.allclose(dense(engine.QUERIES["broadcast_both"](spark, DIR)), m.max(1, keepdims=True) + m.max(0, keepdims=True), rtol=0, atol=1e-4)
