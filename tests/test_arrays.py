"""Operators against golden values and NumPy."""

import math

import numpy as np
import pytest

from gridloom import sources
from gridloom.array import GridArray
from gridloom.errors import AxisError, BroadcastError, IndexRangeError, LinalgError, ShapeMismatchError
from gridloom.operators import combine, creation, elementwise as ew, indexing, linalg, prefix, reductions as red, views
from gridloom.operators.packed import PackedRows
from gridloom.plans import shape as S

nan, inf = math.nan, math.inf


@pytest.fixture
def arr(spark):
    def make(data):
        data = np.asarray(data, float)
        return creation.from_data(spark, data.ravel().tolist(), *data.shape)

    return make


def same(a: GridArray, expected, tol=1e-12):
    expected = np.asarray(expected, float)
    assert a.shape == expected.shape
    np.testing.assert_allclose(a.to_list(), expected.ravel(), rtol=tol, atol=tol)


Z23, RED = np.arange(6.0).reshape(2, 3), np.array([[1, 5, 3], [9, 2, 8.0]])


def test_creation(spark, arr):
    same(creation.new(spark, 2, 2), np.zeros((2, 2)))
    same(creation.ones(spark, 3), np.ones(3))
    same(creation.full(spark, 7, 2), [7, 7])
    same(creation.arange(spark, 5, 0, -2), [5, 3, 1])
    same(creation.arange(spark, 1, 2, 0.5), [1, 1.5])
    same(creation.arange(spark, 0, 0, 1), np.empty(0))
    same(creation.linspace(spark, 0, 1, 5), [0, 0.25, 0.5, 0.75, 1])
    same(creation.linspace(spark, 2, 3, 1), [2])
    same(creation.eye(spark, 2, 4, 2), np.eye(2, 4, 2))
    same(creation.eye(spark, 2, -3), np.eye(2))
    same(creation.identity(spark, 3), np.eye(3))
    assert creation.scalar(spark, 4).at() == 4
    for bad in (lambda: creation.arange(spark, 0, 1, 0), lambda: creation.linspace(spark, 0, 1, -1), lambda: creation.from_data(spark, [1], 2), lambda: creation.new(spark, -1)):
        with pytest.raises(ShapeMismatchError):
            bad()


def test_cells_and_text(spark, arr):
    a = arr([[1, 2.5], [3, 4]])
    assert a.at(1, 0) == 3 and a.set(9, 0, 1).at(0, 1) == 9 and a.at(0, 1) == 2.5
    assert str(arr([1, 2.5, 3])) == "Array(shape=[3], data=[1 2.5 3])" and str(creation.new(spark, 2, 2)) == "Array(shape=[2 2], data=[0 0 0 0])"
    for bad in ((0,), (2, 0), (-1, 0)):
        with pytest.raises(IndexRangeError):
            a.at(*bad)


def test_views(arr):
    x = np.arange(24.0).reshape(2, 3, 4)
    a = arr(x)
    same(views.slice_(a, S.at(1), S.everything(), S.everything()), x[1])
    same(views.slice_(a, S.everything(), S.at(1), S.everything()), x[:, 1])
    same(views.slice_(a, S.at(0), S.between(1, 3), S.every(2)), x[0, 1:3, ::2])
    same(views.slice_(a, S.every(-1), S.starting(-2), S.strided(3, 0, -2)), x[::-1, -2:, 3:0:-2])
    same(views.slice_(a, S.until(-5), S.everything(), S.everything()), x[:-5])
    same(views.transpose(a), x.T)
    same(views.reshape(views.transpose(arr(Z23)), 6), [0, 3, 1, 4, 2, 5])
    assert views.expand_dims(a, -1).shape == (2, 3, 4, 1) and views.squeeze(views.expand_dims(a, 1), 1).shape == a.shape
    same(views.broadcast_to(arr([[1], [2]]), (2, 3)), [[1, 1, 1], [2, 2, 2]])
    with pytest.raises(IndexRangeError):
        views.slice_(a, S.at(0))
    with pytest.raises(AxisError):
        views.expand_dims(a, 5)
    with pytest.raises(ShapeMismatchError):
        views.squeeze(a, 1)


def test_broadcasting(arr, spark):
    m, row, col = np.arange(1.0, 7).reshape(2, 3), np.array([10.0, 20, 30]), np.array([[100.0], [200]])
    same(ew.add(arr(m), arr(row)), m + row)
    same(ew.add(arr(row), arr(m)), m + row)
    same(ew.sub(arr(m), arr(col)), m - col)
    same(ew.mul(arr([[1, 2, 3]]), arr([[10], [20]])), [[10, 20, 30], [20, 40, 60]])
    same(ew.div(arr(m), creation.scalar(spark, 2)), m / 2)
    assert ew.add(creation.zeros(spark, 0, 3), arr(row)).shape == (0, 3)
    with pytest.raises(BroadcastError):
        ew.add(arr(m), arr([1, 2]))
    same(ew.add_into(arr(m), arr(row), creation.zeros(spark, 2, 3)), m + row)
    with pytest.raises(BroadcastError):
        ew.add_into(arr(m), arr(row), creation.zeros(spark, 3))


def test_one_frame_needs_no_join(arr):
    a = arr(Z23)
    plan = ew.add(ew.mul(a, 2.0), ew.sqrt(a)).frame._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_ieee(arr):
    a, b = arr([1, -1, 0, nan, 1, inf]), arr([0, 0, 0, 1, nan, inf])
    same(ew.div(a, b), [inf, -inf, nan, nan, nan, nan])
    same(ew.equal(a, b), [0, 0, 1, 0, 0, 1])
    same(ew.not_equal(a, b), [1, 1, 0, 1, 1, 0])
    same(ew.greater(a, b), [1, 0, 0, 0, 0, 0])
    same(ew.less_equal(a, b), [0, 1, 1, 0, 0, 1])
    same(ew.maximum(arr([nan, 1, nan, -inf]), arr([inf, nan, 2, 1])), [inf, nan, nan, 1])
    same(ew.minimum(arr([nan, 1, nan, inf]), arr([-inf, nan, 2, 1])), [-inf, nan, nan, 1])
    same(ew.log(arr([1, 0, -1, nan])), [0, -inf, nan, nan])
    same(ew.log2(arr([1, 2, 8])), [0, 1, 3])
    same(ew.sqrt(arr([4, -1])), [2, nan])
    same(ew.floor(arr([1.7, -1.2, 1e300, inf, nan])), [1, -2, 1e300, inf, nan])
    same(ew.ceil(arr([1.2, -1.7])), [2, -1])
    same(ew.rint(arr([0.5, 1.5, 2.5, -0.5, 1e300])), [1, 2, 3, -1, 1e300])
    same(ew.power(arr([1, -1, 2, 0]), inf), [1, 1, inf, 0])
    same(ew.power(arr([1, 2]), nan), [1, nan])
    same(ew.clip(arr([nan, 1, 5, 9]), 2, 7), [nan, 2, 5, 7])
    same(ew.clip(arr([1, 9]), nan, 7), [1, 7])
    same(ew.map_(arr([1, 2]), lambda v: v + 1), [2, 3])
    same(ew.where(arr([1, 0, nan]), arr([[5.0]]), arr([[1.0], [2]])), [[5, 1, 5], [5, 2, 5]])
    with pytest.raises(ShapeMismatchError):
        ew.clip(a, 5, 1)


def test_selection(arr):
    a = arr(RED)
    same(indexing.mask_select(a, ew.greater(a, 3.0)), [5, 9, 8])
    same(indexing.mask_select(a, ew.greater(a, 99.0)), np.empty(0))
    same(indexing.nonzero(arr([0, 1, 0, 1, 0, 1])), [1, 3, 5])
    same(indexing.take(arr([10, 20, 30, 40, 50]), 0, 2, 4, -1), [10, 30, 50, 50])
    for bad in (lambda: indexing.take(a, 6), lambda: indexing.mask_select(a, arr(np.ones((2, 2, 3))))):
        with pytest.raises(ShapeMismatchError):
            bad()
    with pytest.raises(BroadcastError):
        indexing.mask_select(a, arr([1, 0, 1, 0]))


def test_reductions(arr, spark):
    a = arr(RED)
    assert (red.sum_(a), red.prod(a), red.max_(a), red.min_(a), red.argmax(a), red.argmin(a)) == (28, 2160, 9, 1, 3, 0)
    assert red.argmax(arr([3, 1, 9, 9, 0, 0])) == 2 and red.argmin(arr([3, 1, 9, 9, 0, 0])) == 4
    assert math.isnan(red.min_(arr([1, nan]))) and math.isnan(red.max_(arr([1, nan])))
    empty = creation.zeros(spark, 0, 3)
    assert red.sum_(empty) == 0 and red.prod(empty) == 1
    for op in (red.mean, red.max_, red.min_, red.argmax, red.argmin):
        with pytest.raises(ShapeMismatchError):
            op(empty)
    with pytest.raises(ShapeMismatchError):
        red.sum_axis(empty, 0)
    assert red.sum_axis(empty, 1).shape == (0,)
    x = np.arange(24.0).reshape(2, 3, 4)
    for axis in (0, 1, 2, -1):
        for ours, numpy in ((red.sum_axis, np.sum), (red.prod_axis, np.prod), (red.max_axis, np.max), (red.min_axis, np.min), (red.mean_axis, np.mean), (red.argmax_axis, np.argmax), (red.argmin_axis, np.argmin)):
            same(ours(arr(x), axis), numpy(x, axis))
    same(red.sum_axis(a, 0, True), RED.sum(0, keepdims=True))
    same(red.sum_axis(arr([3, 1, 4]), 0), 8)
    with pytest.raises(AxisError):
        red.sum_axis(a, 2)


def test_scans(arr, spark, monkeypatch):
    a = arr(RED)
    same(red.cumsum(a, 0), RED.cumsum(0))
    same(red.cumprod(a, -1), RED.cumprod(1))
    same(red.cumsum_flat(a), RED.cumsum())
    same(red.cumprod_flat(a), RED.cumprod())
    assert red.cumsum(creation.zeros(spark, 0, 3), 0).shape == (0, 3)
    x = np.arange(1.0, 101).reshape(5, 20)
    cells = prefix.running(arr(x).frame, S.F.col("lin") % 1, S.F.col("lin"), 100, S.F.sum, block=3)
    assert [r.run for r in sorted(cells.collect(), key=lambda r: r.lin)] == x.cumsum().tolist()
    for block in (4, 1000):
        kept, count = prefix.renumbered(arr(x).frame.where("lin % 7 = 3"), 100, block=block)
        assert [(r.lin, r.v) for r in kept.orderBy("lin").collect()] == list(enumerate(x.ravel()[3::7])) and count == len(x.ravel()[3::7])


def test_combination(arr):
    a, b = Z23, Z23 + 6
    for axis in (0, 1):
        same(combine.concatenate([arr(a), arr(b)], axis), np.concatenate([a, b], axis))
    for axis in (0, 1, 2, -1):
        same(combine.stack([arr(a), arr(b)], axis), np.stack([a, b], axis))
    u, w = [1, 2, 3], [4, 5, 6]
    same(combine.vstack([arr(u), arr(w)]), np.vstack([u, w]))
    same(combine.hstack([arr(u), arr(w)]), np.hstack([u, w]))
    for bad in (lambda: combine.concatenate([], 0), lambda: combine.concatenate([arr(a), arr(u)], 0), lambda: combine.stack([arr(a), arr(u)], 0), lambda: combine.vstack([])):
        with pytest.raises(ShapeMismatchError):
            bad()
    with pytest.raises(AxisError):
        combine.concatenate([arr(a)], 5)


def test_linalg(arr, monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-8, 8, (7, 5)).astype(float), rng.integers(-8, 8, (5, 9)).astype(float)
    for plan in (linalg.matmul, linalg._by_inner, linalg._by_rows):
        same(plan(arr(a), arr(b)), a @ b)
    monkeypatch.setattr(linalg, "SIDE", 2)
    monkeypatch.setattr(linalg, "PARTIALS", 2)
    same(linalg._by_blocks(arr(a), arr(b)), a @ b)
    same(linalg.dot(arr([1, 2, 3]), arr([4, 5, 6])), 32)
    same(linalg.dot(arr(Z23), arr([1, 1, 1])), [3, 12])
    same(linalg.dot(arr([1, 1]), arr(Z23)), [3, 5, 7])
    same(linalg.inner(arr(Z23), arr([[0, 2, 4], [1, 3, 5]])), [[10, 13], [28, 40]])
    same(linalg.outer(arr([[1, 2], [3, 4]]), arr([1, 10])), [[1, 10], [2, 20], [3, 30], [4, 40]])
    for bad in (lambda: linalg.matmul(arr(a), arr(a)), lambda: linalg.dot(arr([1]), arr([1, 2])), lambda: linalg.dot(arr(a), arr([1])), lambda: linalg.inner(arr(a), arr([1])), lambda: linalg.dot(arr(np.ones((1, 1, 1))), arr([1]))):
        with pytest.raises(LinalgError):
            bad()


def test_products_of_tall_matrices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-8, 8, (20_000, 3)).astype(float), rng.integers(-8, 8, (20_000, 4)).astype(float)
    frame = spark.createDataFrame([(k, [float(c) for c in r], [float(c) for c in q]) for k, (r, q) in enumerate(zip(x, y, strict=True))], "k bigint, x array<double>, y array<double>").repartition(5)
    a, b = sources.rows_matrix(frame, "k", "x", 3), sources.rows_matrix(frame, "k", "y", 4)
    monkeypatch.setattr(linalg, "SLAB_CELLS", 7_000)
    for found, wanted in ((linalg.matmul(views.transpose(a), a), x.T @ x), (linalg.matmul(views.transpose(a), b), x.T @ y), (linalg.inner(views.transpose(a), views.transpose(a)), x.T @ x), (linalg.inner(a, views.slice_(b, S.until(2), S.until(3))), x @ y[:2, :3].T)):
        plan = found.frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan  # no pairs of cells on the inner axis
        assert found.shape == wanted.shape and np.array_equal([r.v for r in sorted(found.frame.collect())], wanted.ravel())
    assert "hashpartitioning(slab" not in linalg.matmul(views.transpose(a), a).frame._jdf.queryExecution().executedPlan().toString()


def test_reductions_of_packed_rows(spark):
    x = np.array([[1.0, 5.0, 3.0], [9.0, np.nan, 9.0], [-1.0, -2.0, -2.0], [np.nan, np.nan, np.nan]])
    m = sources.rows_matrix(spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "k bigint, x array<double>"), "k", "x", 3)
    cells = views.reshape(views.ravel(m), 4, 3)
    for op in (red.sum_axis, red.prod_axis, red.max_axis, red.min_axis, red.mean_axis, red.argmax_axis, red.argmin_axis):
        packed, plain = op(m, 1, True), op(cells, 1, True)
        assert "Exchange" not in packed.frame._jdf.queryExecution().executedPlan().toString() and packed.shape == plain.shape == (4, 1)
        assert np.array_equal(packed.to_list(), plain.to_list(), equal_nan=True), op.__name__
        assert np.array_equal(op(m, 0).to_list(), op(cells, 0).to_list(), equal_nan=True)


def test_long_stretches_hold_no_long_array(arr, monkeypatch):
    from gridloom.operators import views as v

    monkeypatch.setattr(v, "SPAN", 4)
    for few in (v.BROADCAST_CELLS, 0):
        monkeypatch.setattr(v, "BROADCAST_CELLS", few)
        for m in (1, 3, 4, 5, 16, 17, 65, 300):
            same(v.broadcast_to(arr([[1], [2]]), (2, m)), np.repeat([[1], [2]], m, 1))
        same(v.broadcast_to(arr([1, 2]), (7, 5, 2)), np.broadcast_to([1, 2], (7, 5, 2)))
        same(v.broadcast_to(arr([[[3]]]), (2, 9, 6)), np.full((2, 9, 6), 3))


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([(1, 2.0, 5, [1.0, 2.0]), (0, 1.0, 4, [3.0, 4.0])], "k bigint, x double, y int, r array<float>")
    x, y = sources.vectors(t, "k", "x", "y")
    same(ew.add(x, y), [5, 7])
    same(sources.columns_matrix(t, "k", "x", "y"), [[1, 4], [2, 5]])
    same(sources.rows_matrix(t, "k", "r", 2), [[3, 4], [1, 2]])
    p = PackedRows.of(t, "k", "r", (2, 2))
    same(p.sum_rows(), [7, 3])
    same(p.max_rows(), [4, 2])
    same(p.min_rows(), [3, 1])
    same(p.dot([1, 10]), [43, 21])
    same(p.cells(), [[3, 4], [1, 2]])
    sources.write(x, str(tmp_path / "x"))
    same(sources.read(spark, str(tmp_path / "x"), x.shape), [1, 2])
    same(x.persist_to(str(tmp_path / "y")), [1, 2])


def test_stream(spark, tmp_path):
    from gridloom.streaming import running_axis_sum

    creation.arange(spark, 0, 6, 1).frame.write.parquet(str(tmp_path / "in"))
    cells = spark.readStream.schema("lin bigint, v double").parquet(str(tmp_path / "in"))
    query = running_axis_sum(cells, (2, 3), 1).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 3.0), (1, 12.0)]
