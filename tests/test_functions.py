"""Vector expressions and metadata filters, on small values worked out by hand."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.functions.filters import Compiler, FilterError, compile_filter


def value(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_distances(spark):
    r = value(spark, l2=V.euclidean(lit(0, 0), lit(3, 4)), dot=V.dot(lit(1, 2), lit(3, 4)), cut=V.dot(lit(1, 2), lit(3, 4, 5), truncate=True), norm=V.magnitude(lit(3, 4)), zero=V.cosine(lit(0, 0), lit(1, 0)), right=V.angular_distance(lit(1, 0), lit(0, 2)), score=V.score(F.lit(1.0)))
    assert (r.l2, r.dot, r.cut, r.norm, r.zero, r.score) == (5.0, 11.0, 11.0, 5.0, 0.0, 0.5)
    assert r.right == pytest.approx(math.pi / 2)


def test_normalize_keeps_zero(spark):
    r = value(spark, a=V.normalize(lit(3, 4)), b=V.normalize(lit(0, 0)))
    assert r.a == [0.6, 0.8] and r.b == [0.0, 0.0]


def test_unlike_dimensions_are_an_error(spark):
    for f in (V.euclidean, V.cosine, V.dot):
        with pytest.raises(PySparkException):
            value(spark, x=f(lit(1, 2), lit(1, 2, 3)))


def test_scalar_quantization(spark):
    r = value(spark, q=V.sq8_encode(lit(-1, 0, 1)), c=V.sq8_encode(lit(2, 2)), d=V.sq8_decode(V.sq8_encode(lit(-1, 0, 1))))
    assert list(r.q.data) == [0, 128, 255] and list(r.c.data) == [0, 0]
    assert max(abs(a - b) for a, b in zip(r.d, [-1, 0, 1])) <= 1 / 255


def test_product_quantization(spark):
    book = [[[0.0], [1.0]], [[0.0, 0.0], [5.0, 5.0], [5.0, 5.0]]]
    assert V.pq_split(3, 2) == [(0, 1), (1, 2)]
    r = value(spark, c=V.pq_encode(lit(0.9, 4, 4), book, 3), d=V.pq_decode(V.pq_encode(lit(0.9, 4, 4), book, 3), book), bad=V.pq_decode(F.array(F.lit(9), F.lit(0)), book), none=V.pq_encode(lit(1), [], 1))
    assert list(r.c) == [1, 1] and list(r.d) == [1.0, 5.0, 5.0] and list(r.bad) == [0.0, 0.0] and list(r.none) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(*[st.lists(st.floats(-100, 100), min_size=n, max_size=n)] * 2)))
def test_invariants(spark, pair):
    a, b = pair
    r = value(spark, ab=V.euclidean(lit(*a), lit(*b)), ba=V.euclidean(lit(*b), lit(*a)), aa=V.euclidean(lit(*a), lit(*a)), cos=V.cosine(lit(*a), lit(*b)))
    assert r.ab == r.ba >= 0 and r.aa == 0 and -1.000001 <= r.cos <= 1.000001


DOCS = [
    {"category": "tech", "published": True, "views": 1500, "tags": ["ai", "ml"], "user": {"name": "ann", "age": 30}},
    {"category": "tech", "published": False, "views": 500.5, "tags": [], "user": None},
    {"category": "sports", "views": "12", "tags": [["ai", "ml"], 7], "odd.key": 1, "nothing": None},
    {"views": True, "user": {"name": "bob", "age": 30.0}},
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id int, text string")
    return df.select("id", F.parse_json("text").alias("metadata")).cache()


@pytest.mark.parametrize(
    ("f", "ids"),
    [
        ({}, [0, 1, 2, 3]), ({"category": "tech"}, [0, 1]), ({"published": True}, [0]), ({"views": 1500}, [0]), ({"views": 1500.0}, []), ({"views": "12"}, [2]), ({"views": True}, [3]),
        ({"tags": "ai"}, [0]), ({"tags": ["ai", "ml"]}, [2]), ({"tags": 7}, [2]), ({"nothing": None}, [2]), ({"absent": None}, []), ({"user": None}, [1]),
        ({"user": {"name": "ann", "age": 30}}, [0]), ({"user.age": 30}, [0]), ({"user.age": 30.0}, [3]), ({"user.age": {"$gte": 30}}, [0, 3]), ({"user.name.first": "x"}, []), ({"odd.key": 1}, []),
        ({"views": {"$gt": 500}}, [0, 1]), ({"views": {"$gte": 1500, "$lte": 1500}}, [0]), ({"views": {"$lt": 1}}, []), ({"views": {"$gt": "1"}}, []), ({"views": {"$gt": 500, "$odd": 1}}, [0, 1]),
        ({"category": {"$in": ["sports", "x"]}}, [2]), ({"tags": {"$in": ["ai"]}}, []), ({"views": {"$in": [], "$gt": 1}}, []),
        ({"$and": []}, [0, 1, 2, 3]), ({"$or": []}, []), ({"$or": [{"category": "sports"}, {"$and": [{"published": True}, {"views": {"$gt": 1}}]}]}, [0, 2]), ({"$and": [{"category": "tech"}], "category": "sports"}, [0, 1]), ({"category": "tech", "published": False}, [1]),
    ],
)
def test_filters(docs, f, ids):
    assert [r.id for r in docs.where(compile_filter(f)).orderBy("id").collect()] == ids
    assert [r.id for r in docs.where(compile_filter(json.dumps(f))).orderBy("id").collect()] == ids


@pytest.mark.parametrize("f", [[], 1, {"$bad": 1}, {"a": {}}, {"a": {"$bad": 1}}, {"a": {"$in": 1}}, {"$and": 1}, {"$or": {}}, {"a": {"$gt": 1, "$gte": 1}}, {"a": {"$lt": 1, "$lte": 1}}, "{"])
def test_filter_errors(spark, f):
    with pytest.raises(FilterError):
        compile_filter(f)


def test_equality_dialect(docs):
    ids = lambda f: [r.id for r in docs.where(compile_filter(f, dialect="equality")).orderBy("id").collect()]
    assert ids({"category": "tech", "tags": "ai"}) == [0]
    assert ids({"views": {"$gt": 1}}) == [] and ids({}) == [0, 1, 2, 3] and ids([]) == []


def test_simple_dialect(docs):
    c = Compiler()
    ids = lambda *a: [r.id for r in docs.where(c.simple(*a)).orderBy("id").collect()]
    assert ids({"category": "tech"}, {"views": ("gt", 1000)}) == [0]
    assert ids({}, {"views": ("odd", 1)}) == [] and ids() == [0, 1, 2, 3]


def test_typed_columns_are_pushed_down(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("views")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(compile_filter({"views": {"$gte": 190}}, typed={"views": ("views", "bigint")}))
    assert df.count() == 5
    assert "GreaterThanOrEqual(views" in df._jdf.queryExecution().toString()
