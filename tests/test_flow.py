"""Literal expectations for list verbs."""

import pytest
from pyspark.sql import functions as F

from semiflow.operators.flow import Flow, positions


@pytest.fixture(scope="module")
def xs(spark):
    return Flow(spark.createDataFrame([(i, i) for i in range(1, 11)], "k long, x long"), ("k",))


@pytest.fixture(scope="module")
def dup(spark):
    return Flow(spark.createDataFrame(list(enumerate([1, 1, 2, 2, 3, 1, 1, 4])), "k long, x long"), ("k",))


def vals(f, column="x"):
    return [r[column] for r in f.df.orderBy(*f.by).collect()]


def one(df):
    return df.first()[0]


def test_slices(xs):
    assert vals(xs.take(3)) == [1, 2, 3] and vals(xs.drop(7)) == [8, 9, 10] and vals(xs.take(0)) == [] and vals(xs.drop(99)) == []
    assert vals(xs.take_while(F.col("x") < 4)) == [1, 2, 3] and vals(xs.drop_while(F.col("x") < 4)) == [4, 5, 6, 7, 8, 9, 10]
    assert vals(xs.take_while(F.col("x") < 99)) == list(range(1, 11)) and vals(xs.drop_while(F.col("x") < 99)) == []
    assert vals(xs.drop_last()) == list(range(1, 10)) and vals(xs.rest()) == list(range(2, 11))
    assert vals(xs.take_nth(3)) == [1, 4, 7, 10] and vals(xs.take_nth(0)) == list(range(1, 11))
    assert vals(xs.reverse()) == list(range(10, 0, -1))


def test_elements(xs):
    assert one(xs.nth(2, "x", -1)) == 3 and one(xs.nth(77, "x", -1)) == -1
    assert one(xs.first("x")) == 1 and one(xs.second("x")) == 2 and one(xs.last("x")) == 10
    none = xs.filter(F.lit(False))
    assert one(none.first("x")) is None and one(none.apply("+", "x")) == 0 and one(none.apply("max", "x")) == 0 and one(none.apply("*", "x")) == 1
    with pytest.raises(ValueError):
        xs.apply("min", "x")


def test_combining(xs, dup):
    assert vals(dup.dedupe("x")) == [1, 2, 3, 1, 4] and vals(dup.distinct("x")) == [1, 2, 3, 4]
    assert vals(xs.take(2).concat(dup.take(3))) == [1, 2, 1, 1, 2]
    assert vals(xs.take(3).interpose(F.lit(0).cast("long"), "x")) == [1, 0, 2, 0, 3]
    assert [(r.l, r.r) for r in xs.zip(dup.take(3), "x", "x").df.orderBy("_pos").collect()] == [(1, 1), (2, 1), (3, 2)]
    assert vals(xs.interleave(dup.take(2), "x", "x"), "value") == [1, 1, 2, 1]
    assert vals(xs.partition_all(4, "x"), "chunk") == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]]
    assert vals(xs.partition(4, "x"), "chunk") == [[1, 2, 3, 4], [5, 6, 7, 8]] and vals(xs.take(3).partition_all(0, "x"), "chunk") == [[1, 2, 3]]
    assert vals(xs.reductions(F.col("x"), 100), "value") == [100, 101, 103, 106, 110, 115, 121, 128, 136, 145, 155]
    assert vals(dup.sort("x").indexed(), "k") == [0, 1, 5, 6, 2, 3, 4, 7]


def test_folds(xs):
    assert one(xs.reduce(F.sum("x"), 1)) == 56 and one(xs.filter(F.lit(False)).reduce(F.sum("x"), 7)) == 7
    assert one(xs.fold_ordered(lambda a, v: 10 * a + v, 0, "x")) == 1234567900
    assert one(xs.some(F.col("x") > 9)) is True and one(xs.every(F.col("x") > 1)) is False
    none = xs.filter(F.lit(False))
    assert one(none.some(F.lit(True))) is False and one(none.every(F.lit(False))) is True


def test_stages_in_order(xs):
    y = xs.map((F.col("x") + 1).alias("x")).filter(F.col("x") % 2 == 0).take(3)
    assert vals(y) == [2, 4, 6]
    assert vals(xs.map((F.col("x") * 2).alias("x")).take(4).filter(F.col("x") > 2)) == [4, 6, 8]
    assert vals(xs.take(2).mapcat(F.array("x", F.col("x") * 10)), "value") == [1, 10, 2, 20]


def test_nulls_are_values(spark):
    x = Flow(spark.createDataFrame([(1, None), (2, 5), (3, None)], "k long, x long"), ("k",))
    y = Flow(spark.createDataFrame([(None,), (7,)], "y long"))
    assert vals(x.remove(F.col("x") > 3)) == [None, None] and x.join(y, F.col("x"), F.col("y")).count() == 2
    assert vals(x.member_of(y, F.col("x"), F.col("y")), "k") == [1, 3] and vals(x.member_of(y, F.col("x"), F.col("y"), absent=True), "k") == [2]
    assert vals(x.dedupe("x")) == [None, 5, None]


def test_join_multiplies_copies(spark):
    a = Flow(spark.createDataFrame([(1,), (2,), (3,)], "x long"))
    b = Flow(spark.createDataFrame([(2,), (2,), (3,), (4,)], "y long"))
    assert sorted((r.l.x, r.r.y) for r in a.join(b, F.col("x"), F.col("y")).collect()) == [(2, 2), (2, 2), (3, 3)]


def test_positions_with_ties_nulls_and_texts(spark):
    df = spark.createDataFrame([(None, 2), ("b", 1), ("a", 3), ("a", 1), (None, 1)], "s string, i long")
    got = positions(df, ("s", "i")).orderBy("_pos").collect()
    assert [(r.s, r.i, r._pos) for r in got] == [(None, 1, 0), (None, 2, 1), ("a", 1, 2), ("a", 3, 3), ("b", 1, 4)]


def test_order_is_asked_for(spark):
    with pytest.raises(ValueError):
        Flow(spark.range(3)).take(1)


def test_records_and_groups(spark):
    g = spark.createDataFrame([(i % 7, i % 100) for i in range(5000)], "dept long, sal long")
    got = {r.dept: (r.s, r.lo, r.hi, r.b) for r in Flow(g).group_by("dept").agg(F.sum("sal").alias("s"), F.min("sal").alias("lo"), F.max("sal").alias("hi"), F.bit_or("sal").alias("b")).collect()}
    for d in range(7):
        v = [i % 100 for i in range(5000) if i % 7 == d]
        b = 0
        for x in v:
            b |= x
        assert got[d] == (sum(v), min(v), max(v), b)
