"""One query per operator over the driver's tables, with its DuckDB statement.

Bindings: E = events.value by event_id as a vector, or as a matrix of 100
columns; C = customer.c_acctbal by c_custkey; M = embeddings as rows of 64;
P = part (p_size, p_retailprice) as two columns.  Float results are rounded to
the same number of decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sources
from .array import GridArray
from .errors import GridError
from .operators import combine, creation, elementwise, indexing, linalg, reductions, views
from .operators.packed import PackedRows
from .plans import shape as S

QUERIES, SQL = {}, {}
COLUMNS, WIDTH = 100, 64


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def E(spark, d):
    return sources.vector(_table(spark, d, "events"), "event_id", "value")


def EM(spark, d):
    return views.reshape(E(spark, d), -1, COLUMNS)


def C(spark, d):
    return sources.vector(_table(spark, d, "customer"), "c_custkey", "c_acctbal")


def M(spark, d):
    return sources.rows_matrix(_table(spark, d, "embeddings"), "vec_id", "embedding", WIDTH)


def P(spark, d):
    return sources.columns_matrix(_table(spark, d, "part"), "p_partkey", "p_size", "p_retailprice")


def shown(a: GridArray, decimals: int = 4):
    return a.cells().withColumn("v", F.round("v", decimals))


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH e AS (SELECT event_id AS i, value AS v FROM events), em AS (SELECT event_id // 100 AS i, event_id % 100 AS j, value AS v FROM events), c AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer), m AS (SELECT vec_id AS i, unnest(generate_series(0, 63)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT p_partkey AS i, 0 AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part) " + sql
        return f

    return register


def array_query(name: str, sql: str | None, decimals: int = 4):
    """A query that shows an array's cells as (i0, i1, ..., v)."""

    def register(f):
        return query(name, sql)(lambda spark, d: shown(f(spark, d), decimals))

    return register


# creation
_GRID = "SELECT (k // 7)::BIGINT AS i0, (k % 7)::BIGINT AS i1, {} AS v FROM range(35) r(k)"
array_query("new_zeros", _GRID.format("0.0::DOUBLE"))(lambda s, d: creation.new(s, 5, 7))
array_query("zeros", _GRID.format("0.0::DOUBLE"))(lambda s, d: creation.zeros(s, 5, 7))
array_query("ones", _GRID.format("1.0::DOUBLE"))(lambda s, d: creation.ones(s, 5, 7))
array_query("full", _GRID.format("2.5::DOUBLE"))(lambda s, d: creation.full(s, 2.5, 5, 7))
array_query("from_data", _GRID.format("((k * 37) % 11)::DOUBLE"))(lambda s, d: creation.from_data(s, [(k * 37) % 11 for k in range(35)], 5, 7))
array_query("arange", "SELECT k::BIGINT AS i0, round(5 - 0.25::DOUBLE * k, 4) AS v FROM range(40) r(k)")(lambda s, d: creation.arange(s, 5, -5, -0.25))
array_query("linspace", "SELECT k::BIGINT AS i0, round(k / 10.0::DOUBLE, 4) AS v FROM range(11) r(k)")(lambda s, d: creation.linspace(s, 0, 1, 11))
array_query("eye", _GRID.format("CASE WHEN k % 7 = k // 7 + 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))(lambda s, d: creation.eye(s, 5, 7, 2))
array_query("identity", "SELECT (k // 6)::BIGINT AS i0, (k % 6)::BIGINT AS i1, CASE WHEN k % 6 = k // 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(36) r(k)")(lambda s, d: creation.identity(s, 6))
query("scalar", "SELECT 3.5::DOUBLE AS v")(lambda s, d: creation.scalar(s, 3.5).cells())
array_query("table_source", "SELECT i AS i0, round(v, 4) AS v FROM e")(E)
array_query("matrix_source", "SELECT i AS i0, j::BIGINT AS i1, round(v, 4) AS v FROM p")(P)

# introspection and materialisation


@query("shape_ndim_size", "SELECT count(*) // 100 AS rows, 100::BIGINT AS columns, 2::BIGINT AS ndim, count(*) AS size FROM e")
def _shape(s, d):
    a = EM(s, d)
    return s.createDataFrame([(*a.shape, a.ndim, a.size)], "rows bigint, columns bigint, ndim bigint, size bigint")


query("at", "SELECT v FROM e WHERE i = 507")(lambda s, d: s.createDataFrame([(EM(s, d).at(5, 7),)], "v double"))
array_query("set", "SELECT i AS i0, CASE WHEN i = 3 THEN -1.5 ELSE round(v, 4) END AS v FROM e")(lambda s, d: E(s, d).set(-1.5, 3))
array_query("copy", "SELECT i AS i0, round(v, 4) AS v FROM e")(lambda s, d: E(s, d).copy())
query("to_string", "SELECT 'Array(shape=[2 3], data=[0 1 2 3 4 5])' AS text")(lambda s, d: s.createDataFrame([(str(views.reshape(creation.arange(s, 0, 6, 1), 2, 3)),)], "text string"))

# views
_EM = "SELECT {} AS i0, {} AS i1, round(v, 4) AS v FROM em"
array_query("reshape", _EM.format("i", "j"))(EM)
array_query("ravel", "SELECT i * 100 + j AS i0, round(v, 4) AS v FROM em")(lambda s, d: views.ravel(EM(s, d)))
array_query("flatten", "SELECT i * 100 + j AS i0, round(v, 4) AS v FROM em")(lambda s, d: views.flatten(EM(s, d)))
array_query("transpose", _EM.format("j", "i"))(lambda s, d: views.transpose(EM(s, d)))
array_query("expand_dims", "SELECT i AS i0, 0::BIGINT AS i1, j AS i2, round(v, 4) AS v FROM em")(lambda s, d: views.expand_dims(EM(s, d), 1))
array_query("squeeze", _EM.format("i", "j"))(lambda s, d: views.squeeze(views.expand_dims(EM(s, d), -1)))
array_query("slice_int", "SELECT j AS i0, round(v, 4) AS v FROM em WHERE i = (SELECT max(i) - 1 FROM em)")(lambda s, d: views.slice_(EM(s, d), S.at(-2), S.everything()))
array_query("slice_range", "SELECT i - 1 AS i0, j - 10 AS i1, round(v, 4) AS v FROM em WHERE i BETWEEN 1 AND 3 AND j >= 10 AND j < 20")(lambda s, d: views.slice_(EM(s, d), S.between(1, 4), S.between(10, 20)))
array_query("slice_step", "SELECT i // 2 AS i0, (98 - j) // 3 AS i1, round(v, 4) AS v FROM em WHERE i % 2 = 0 AND j <= 98 AND j > 5 AND (98 - j) % 3 = 0")(lambda s, d: views.slice_(EM(s, d), S.every(2), S.strided(98, 5, -3)))
array_query("slice_from_to", "SELECT i - 4 AS i0, j AS i1, round(v, 4) AS v FROM em WHERE i >= 4 AND j < 98")(lambda s, d: views.slice_(EM(s, d), S.starting(4), S.until(-2)))
array_query("slice_reverse", "SELECT (SELECT max(i) FROM e) - i AS i0, round(v, 4) AS v FROM e")(lambda s, d: views.slice_(E(s, d), S.every(-1)))
array_query("broadcast_to", "SELECT k AS i0, i AS i1, round(v, 4) AS v FROM c, range(3) r(k)")(lambda s, d: (lambda a: views.broadcast_to(a, (3, a.size)))(C(s, d)))

# comparisons: against the array reversed, and with NaN from log of negatives
_PAIR = "(SELECT a.i, a.v AS x, b.v AS y FROM c a JOIN c b ON b.i = (SELECT max(i) FROM c) - a.i)"


def _pair(s, d):
    a = C(s, d)
    return a, views.slice_(a, S.every(-1))


for _name, _op, _sql in (
    ("equal", elementwise.equal, "x = y"), ("not_equal", elementwise.not_equal, "x <> y"), ("greater", elementwise.greater, "x > y"),
    ("greater_equal", elementwise.greater_equal, "x >= y"), ("less", elementwise.less, "x < y"), ("less_equal", elementwise.less_equal, "x <= y"),
):
    array_query(_name, f"SELECT i AS i0, CASE WHEN {_sql} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {_PAIR}")(lambda s, d, op=_op: op(*_pair(s, d)))
for _name, _op, _sql in (
    ("add", elementwise.add, "x + y"), ("sub", elementwise.sub, "x - y"), ("mul", elementwise.mul, "x * y"), ("div", elementwise.div, "x / y"),
    ("maximum", elementwise.maximum, "greatest(x, y)"), ("minimum", elementwise.minimum, "least(x, y)"),
):
    array_query(_name, f"SELECT i AS i0, round({_sql}, 4) AS v FROM {_PAIR}")(lambda s, d, op=_op: op(*_pair(s, d)))
for _name, _op, _sql in (("add_scalar", elementwise.add_scalar, "v + 10.5"), ("sub_scalar", elementwise.sub_scalar, "v - 10.5"), ("mul_scalar", elementwise.mul_scalar, "v * 10.5"), ("div_scalar", elementwise.div_scalar, "v / 10.5::DOUBLE")):
    array_query(_name, f"SELECT i AS i0, round({_sql}, 4) AS v FROM c")(lambda s, d, op=_op: op(C(s, d), 10.5))
for _name, _op, _sql in (("add_into", elementwise.add_into, "x + y"), ("sub_into", elementwise.sub_into, "x - y"), ("mul_into", elementwise.mul_into, "x * y"), ("div_into", elementwise.div_into, "x / y")):
    array_query(_name, f"SELECT i AS i0, round({_sql}, 4) AS v FROM {_PAIR}")(lambda s, d, op=_op: op(*(p := _pair(s, d)), creation.zeros(s, *p[0].shape)))
array_query("sqrt_into", "SELECT i AS i0, round(sqrt(v), 6) AS v FROM e", 6)(lambda s, d: elementwise.sqrt_into(E(s, d), E(s, d)))
_N = "CASE WHEN v {} THEN 'NaN'::DOUBLE ELSE {} END"
for _name, _op, _sql in (
    ("neg", elementwise.neg, "-v"), ("abs", elementwise.absolute, "abs(v)"), ("sqrt", elementwise.sqrt, _N.format("< 0", "sqrt(abs(v))")), ("log", elementwise.log, _N.format("< 0", "ln(abs(v))")),
    ("log2", elementwise.log2, _N.format("< 0", "log2(abs(v))")), ("log10", elementwise.log10, _N.format("< 0", "log10(abs(v))")), ("sin", elementwise.sin, "sin(v)"), ("cos", elementwise.cos, "cos(v)"),
    ("floor", elementwise.floor, "floor(v)"), ("ceil", elementwise.ceil, "ceil(v)"), ("round", elementwise.rint, "round(v)"), ("square", elementwise.square, "v * v"),
    ("exp", lambda a: elementwise.exp(elementwise.div(a, 5000.0)), "exp(v / 5000)"), ("tan", lambda a: elementwise.tan(elementwise.div(a, 10000.0)), "tan(v / 10000)"),
    ("power", lambda a: elementwise.power(a, 3.0), "v * v * v"), ("clip", lambda a: elementwise.clip(a, -100.0, 5000.0), "least(greatest(v, -100), 5000)"),
    ("map", lambda a: elementwise.map_(a, lambda v: v * 2 + 1), "v * 2 + 1"),
):
    _places = 2 if _name == "power" else 6
    array_query(_name, f"SELECT i AS i0, round({_sql}, {_places}) AS v FROM c", _places)(lambda s, d, op=_op: op(C(s, d)))
array_query("divide_by_zero", "SELECT i AS i0, CASE WHEN v > 0 THEN 'Infinity'::DOUBLE WHEN v < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS v FROM c")(lambda s, d: elementwise.div(C(s, d), 0.0))
array_query("nan_comparison", "SELECT i AS i0, CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM c")(lambda s, d: (lambda x: elementwise.not_equal(x, x))(elementwise.sqrt(C(s, d))))
array_query("broadcast_row", "SELECT i AS i0, j AS i1, round(v + (SELECT b.v FROM e b WHERE b.i = em.j), 4) AS v FROM em")(lambda s, d: elementwise.add(EM(s, d), views.slice_(E(s, d), S.until(COLUMNS))))
array_query("broadcast_column", "SELECT i AS i0, j AS i1, round(v * (SELECT b.v FROM em b WHERE b.i = em.i AND b.j = 0), 4) AS v FROM em")(lambda s, d: (lambda a: elementwise.mul(a, views.slice_(a, S.everything(), S.until(1))))(EM(s, d)))
array_query("broadcast_both", "SELECT a.i AS i0, b.j::BIGINT AS i1, round(a.v + b.v, 4) AS v FROM (SELECT i, max(v) AS v FROM m GROUP BY 1) a, (SELECT j, max(v) AS v FROM m GROUP BY 1) b")(lambda s, d: (lambda a: elementwise.add(reductions.max_axis(a, 1, True), reductions.max_axis(a, 0, True)))(M(s, d)))
array_query("where", f"SELECT i AS i0, round(CASE WHEN x > 0 THEN y ELSE x END, 4) AS v FROM {_PAIR}")(lambda s, d: (lambda a, b: elementwise.where(elementwise.greater(a, 0.0), b, a))(*_pair(s, d)))

# selection
array_query("mask_select", "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, round(v, 4) AS v FROM e WHERE v > 50")(lambda s, d: (lambda a: indexing.mask_select(a, elementwise.greater(a, 50.0)))(E(s, d)))
array_query("nonzero", "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, i::DOUBLE AS v FROM c WHERE v < 0")(lambda s, d: indexing.nonzero(elementwise.less(C(s, d), 0.0)))
array_query("take", "SELECT k.p AS i0, round(v, 4) AS v FROM e JOIN (VALUES (0, 5), (1, 0), (2, 5), (3, (SELECT max(i) FROM e))) k(p, q) ON e.i = k.q")(lambda s, d: indexing.take(E(s, d), 5, 0, 5, -1))

# reductions


def _reduced(name: str, sql: str, decimals: int = 4):
    query(name, f"SELECT {sql} AS v FROM c")(lambda s, d: reductions.whole_frame(C(s, d), name.split("_")[0]).select(F.round(F.col("v").cast("double"), decimals).alias("v")))


for _name, _sql in (("sum", "round(sum(v), 4)"), ("mean", "round(avg(v), 4)"), ("max", "round(max(v), 4)"), ("min", "round(min(v), 4)"), ("argmax", "(SELECT min(i) FROM c WHERE v = (SELECT max(v) FROM c))::DOUBLE"), ("argmin", "(SELECT min(i) FROM c WHERE v = (SELECT min(v) FROM c))::DOUBLE")):
    _reduced(_name, _sql if not _name.startswith("arg") else f"any_value({_sql})")
query("prod", "SELECT round(ln(product(1 + v / 10000)), 6) AS v FROM c")(lambda s, d: reductions.whole_frame(elementwise.add(elementwise.div(C(s, d), 10000.0), 1.0), "prod").select(F.round(F.ln("v"), 6).alias("v")))
query("masked_sum", "SELECT round(sum(v), 4) AS v FROM e WHERE v > 50")(lambda s, d: (lambda a: reductions.whole_frame(indexing.mask_select(a, elementwise.greater(a, 50.0)), "sum"))(E(s, d)).select(F.round("v", 4).alias("v")))
for _name, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)")):
    for _axis in (0, 1):
        array_query(f"{_name}_axis{_axis}", f"SELECT {'ij'[1 - _axis]} AS i0, round({_sql}, 4) AS v FROM em GROUP BY 1")(lambda s, d, op=getattr(reductions, f"{_name}_axis"), k=_axis: op(EM(s, d), k))
array_query("prod_axis1", "SELECT i AS i0, round(product(1 + v / 1000), 4) AS v FROM em GROUP BY 1")(lambda s, d: reductions.prod_axis(elementwise.add(elementwise.div(EM(s, d), 1000.0), 1.0), 1))
array_query("prod_axis0", "SELECT j AS i0, round(product(1 + v / 1000000), 6) AS v FROM em GROUP BY 1", 6)(lambda s, d: reductions.prod_axis(elementwise.add(elementwise.div(EM(s, d), 1e6), 1.0), 0))
array_query("sum_axis_keepdims", "SELECT 0::BIGINT AS i0, j AS i1, round(sum(v), 4) AS v FROM em GROUP BY 2")(lambda s, d: reductions.sum_axis(EM(s, d), 0, True))
for _name, _f in (("argmax", "max"), ("argmin", "min")):
    for _axis in (0, 1):
        _out, _in = ("j", "i") if _axis == 0 else ("i", "j")
        array_query(f"{_name}_axis{_axis}", f"SELECT {_out} AS i0, min({_in})::DOUBLE AS v FROM (SELECT *, {_f}(v) OVER (PARTITION BY {_out}) AS b FROM em) WHERE v = b GROUP BY 1")(lambda s, d, op=getattr(reductions, f"{_name}_axis"), k=_axis: op(EM(s, d), k))
array_query("packed_sum_rows", "SELECT i AS i0, round(sum(v), 6) AS v FROM m GROUP BY 1", 6)(lambda s, d: (lambda t: PackedRows.of(t, "vec_id", "embedding", (t.count(), WIDTH)).sum_rows())(_table(s, d, "embeddings")))
array_query("cumsum_axis0", "SELECT i AS i0, j AS i1, round(sum(v) OVER (PARTITION BY j ORDER BY i), 4) AS v FROM em")(lambda s, d: reductions.cumsum(EM(s, d), 0))
array_query("cumsum_axis1", "SELECT i AS i0, j AS i1, round(sum(v) OVER (PARTITION BY i ORDER BY j), 4) AS v FROM em")(lambda s, d: reductions.cumsum(EM(s, d), 1))
array_query("cumprod_axis1", "SELECT i AS i0, j AS i1, round(product(1 + v / 1000) OVER (PARTITION BY i ORDER BY j), 4) AS v FROM em")(lambda s, d: reductions.cumprod(elementwise.add(elementwise.div(EM(s, d), 1000.0), 1.0), 1))
array_query("cumprod_axis0", "SELECT i AS i0, j AS i1, round(product(1 + v / 1000000) OVER (PARTITION BY j ORDER BY i), 6) AS v FROM em", 6)(lambda s, d: reductions.cumprod(elementwise.add(elementwise.div(EM(s, d), 1e6), 1.0), 0))
array_query("cumsum_flat", "SELECT i AS i0, round(sum(v) OVER (ORDER BY i), 4) AS v FROM e")(lambda s, d: reductions.cumsum_flat(EM(s, d)))
array_query("cumprod_flat", "SELECT i AS i0, round(product(1 + v / 1000000) OVER (ORDER BY i), 6) AS v FROM e", 6)(lambda s, d: reductions.cumprod_flat(elementwise.add(elementwise.div(EM(s, d), 1e6), 1.0)))

# NaN and empty arrays: maxima and minima that meet a NaN are NaN, and only sums and products of nothing have a value
_ROOT = "CASE WHEN v < 50 THEN 'NaN'::DOUBLE ELSE round(sqrt(v - 50), 4) END"
_ROOTS = lambda s, d: elementwise.sqrt(elementwise.sub(EM(s, d), 50.0))
for _name in ("max", "min"):
    query(f"{_name}_nan", f"SELECT CASE WHEN bool_or(v < 0) THEN 'NaN'::DOUBLE ELSE {_name}(round(sqrt(abs(v)), 4)) END AS v FROM c")(lambda s, d, name=_name: reductions.whole_frame(elementwise.sqrt(C(s, d)), name).select(F.round("v", 4).alias("v")))
    for _axis in (0, 1):
        array_query(f"{_name}_axis{_axis}_nan", f"SELECT {'ij'[1 - _axis]} AS i0, CASE WHEN bool_or(v < 50) THEN 'NaN'::DOUBLE ELSE {_name}(x) END AS v FROM (SELECT *, {_ROOT} AS x FROM em) GROUP BY 1")(lambda s, d, op=getattr(reductions, f"{_name}_axis"), k=_axis: op(_ROOTS(s, d), k))


def _said(spark, calls):
    """What each call gives, or the error that it raises."""
    rows = []
    for name, call in calls:
        try:
            rows.append((name, str(call())))
        except GridError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "call string, result string")


def _values(rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") t(call, result)"


@query("empty_reductions", _values([("sum", "0.0"), ("prod", "1.0"), *[(f, "ShapeMismatchError") for f in ("mean", "max", "min", "argmax", "argmin")], ("sum_axis", "ShapeMismatchError"), ("sum of no rows", "Array(shape=[0], data=[])")]))
def _empty_reductions(s, d):
    nothing = views.slice_(C(s, d), S.until(0))
    calls = [(f, lambda f=f: getattr(reductions, f)(nothing)) for f in ("prod", "mean", "argmax", "argmin")]
    calls += [("sum", lambda: reductions.sum_(nothing)), ("max", lambda: reductions.max_(nothing)), ("min", lambda: reductions.min_(nothing))]
    calls += [("sum_axis", lambda: reductions.sum_axis(creation.zeros(s, 0, 3), 0)), ("sum of no rows", lambda: reductions.sum_axis(creation.zeros(s, 0, 3), 1))]
    return _said(s, calls)


_ERRORS = [
    ("reshape", "ShapeMismatchError", lambda a, m: views.reshape(a, -1, a.size + 1)),
    ("negative shape", "ShapeMismatchError", lambda a, m: creation.zeros(a.spark, -1)),
    ("step of zero", "ShapeMismatchError", lambda a, m: creation.arange(a.spark, 0, 5, 0)),
    ("add", "BroadcastError", lambda a, m: elementwise.add(views.slice_(a, S.until(3)), views.slice_(a, S.until(2)))),
    ("broadcast_to", "BroadcastError", lambda a, m: views.broadcast_to(views.slice_(a, S.until(3)), (2, 2))),
    ("axis", "AxisError", lambda a, m: reductions.sum_axis(m, 2)),
    ("expand_dims", "AxisError", lambda a, m: views.expand_dims(m, 4)),
    ("at", "IndexRangeError", lambda a, m: a.at(a.size)),
    ("slice", "IndexRangeError", lambda a, m: views.slice_(m, S.everything())),
    ("matmul", "LinalgError", lambda a, m: linalg.matmul(m, m)),
    ("dot", "LinalgError", lambda a, m: linalg.dot(a, views.slice_(a, S.until(2)))),
    ("inner", "LinalgError", lambda a, m: linalg.inner(a, m)),
]


@query("error_rules", _values([(name, error) for name, error, _ in _ERRORS]))
def _error_rules(s, d):
    a, m = C(s, d), P(s, d)
    return _said(s, [(name, lambda f=f: f(a, m)) for name, _, f in _ERRORS])


# combination
_TWO = "SELECT i AS i0, j::BIGINT AS i1, round(v, 4) AS v FROM p UNION ALL "
array_query("concatenate_axis0", _TWO + "SELECT i + (SELECT count(*) FROM part), j, round(v, 4) FROM p")(lambda s, d: combine.concatenate([P(s, d), P(s, d)], 0))
array_query("concatenate_axis1", _TWO + "SELECT i, j + 2, round(v, 4) FROM p")(lambda s, d: combine.concatenate([P(s, d), P(s, d)], 1))
array_query("stack_axis1", "SELECT i AS i0, k AS i1, j::BIGINT AS i2, round(v * (k + 1), 4) AS v FROM p, range(2) r(k)")(lambda s, d: combine.stack([P(s, d), elementwise.mul(P(s, d), 2.0)], 1))
array_query("vstack", "SELECT k AS i0, i AS i1, round(v * (k + 1), 4) AS v FROM c, range(2) r(k)")(lambda s, d: combine.vstack([C(s, d), elementwise.mul(C(s, d), 2.0)]))
array_query("hstack", _TWO + "SELECT i, j + 2, round(v, 4) FROM p")(lambda s, d: combine.hstack([P(s, d), P(s, d)]))

# linear algebra
array_query("matmul_embeddings", "SELECT a.j::BIGINT AS i0, b.j::BIGINT AS i1, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2", 6)(lambda s, d: (lambda a: linalg.matmul(views.transpose(a), a))(M(s, d)))
query("dot_vectors", f"SELECT round(sum(x * y), 2) AS v FROM {_PAIR}")(lambda s, d: linalg.dot(*_pair(s, d)).frame.select(F.round("v", 2).alias("v")))
array_query("dot_matrices", "SELECT a.j::BIGINT AS i0, b.j::BIGINT AS i1, round(sum(a.v * b.v), 2) AS v FROM p a JOIN p b ON a.i = b.i GROUP BY 1, 2", 2)(lambda s, d: linalg.dot(views.transpose(P(s, d)), P(s, d)))
array_query("dot_matrix_vector", "SELECT i AS i0, round(sum(em.v * (SELECT b.v FROM e b WHERE b.i = em.j)), 4) AS v FROM em GROUP BY 1")(lambda s, d: linalg.dot(EM(s, d), views.slice_(E(s, d), S.until(COLUMNS))))
array_query("dot_vector_matrix", "SELECT j AS i0, round(sum(em.v * (SELECT b.v FROM e b WHERE b.i = em.i)), 4) AS v FROM em GROUP BY 1")(lambda s, d: (lambda a: linalg.dot(views.slice_(E(s, d), S.until(a.shape[0])), a))(EM(s, d)))
array_query("inner", "SELECT a.j::BIGINT AS i0, b.j::BIGINT AS i1, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2", 6)(lambda s, d: (lambda a: linalg.inner(a, a))(views.transpose(M(s, d))))
array_query("outer", "SELECT a.i AS i0, b.j::BIGINT AS i1, round(a.v * b.v, 4) AS v FROM (SELECT i, max(v) AS v FROM m GROUP BY 1) a, (SELECT j, max(v) AS v FROM m GROUP BY 1) b")(lambda s, d: (lambda a: linalg.outer(reductions.max_axis(a, 1), reductions.max_axis(a, 0)))(M(s, d)))


def big_vector(spark, n: int = 1 << 22):
    """(i % 97) * 0.5, the baseline's vector."""
    return GridArray.of(spark.range(n).select(F.col("id").alias("lin"), ((F.col("id") % 97) * F.lit(0.5)).alias("v")), (n,))


def big_matrix(spark, rows: int = 1024, columns: int = 1024):
    """(i % 101) * 0.25, the baseline's matrix."""
    n = rows * columns
    return GridArray.of(spark.range(n).select(F.col("id").alias("lin"), ((F.col("id") % 101) * F.lit(0.25)).alias("v")), (rows, columns))
