"""Types that folds keep, and ranges that stay even."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from semiflow import scratch
from semiflow.functions import monoids
from semiflow.operators.flow import Flow, positions


def test_folds_keep_doubles_and_strings(spark):
    df = spark.createDataFrame([("a", 0.6, "x"), ("a", 0.7, "z"), ("b", 1.5, "y"), (None, 0.25, "q")], "k string, v double, s string")
    plus = monoids.foreign("plus-outside", 0, lambda a, b: a + b, {"associative", "commutative"})
    last = monoids.foreign("last-word", "", max, {"associative", "commutative", "idempotent"})
    assert abs(monoids.fold(df, plus, F.col("v")).first()[0] - 3.05) < 1e-12
    assert {r.k: round(r.value, 9) for r in monoids.group_by(df, plus, "k", F.col("v")).collect()} == {"a": 1.3, "b": 1.5, None: 0.25}
    assert {r.k: r.value for r in monoids.group_by(df, last, "k", F.col("s")).collect()} == {"a": "z", "b": "y", None: "q"}
    assert monoids.fold(df, last, F.col("s")).first()[0] == "z" and monoids.fold(df.limit(0), last, F.col("s"), "none").first()[0] == "none"
    big = spark.createDataFrame([(2**60 + 1, 1), (None, 2), (2**60 + 1, None), (7, None)], "k long, v long")
    assert {r.k: r.value for r in monoids.group_by(big, plus, "k", F.col("v")).collect()} == {2**60 + 1: 1, None: 2, 7: None}
    assert monoids.merge_by(df, plus, "k", "v").schema == df.select("k", "v").schema


def test_products_are_exact(spark):
    df = spark.createDataFrame([(3,)] * 40, "x long")
    assert Flow(df).apply("*", "x").first()[0] == 3**40
    assert Flow(df.limit(0)).apply("*", "x").first()[0] == Decimal(1)


def test_positions_of_a_column_with_two_values(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("two"))
    x = positions(rows, ("two",))
    assert sorted(r[0] for r in x.select("_pos").collect()) == list(range(20_000))
    assert x.filter("_pos < 10000").agg(F.max("two")).first()[0] == 0 and x.filter("_pos >= 10000").agg(F.min("two")).first()[0] == 1
    sizes = [len(p) for p in x.select("_pos").rdd.glom().collect()]
    assert max(sizes) <= 3 * 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_concat_and_dedupe_over_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1, 1, 1, 2])) for i in range(500)]
    x = Flow(spark.createDataFrame(rows, "k long, v int"), ("k",))
    want = [v for i, (_, v) in enumerate(rows) if not i or rows[i - 1][1] != v]
    assert [q.v for q in x.dedupe("v").sorted_rows().collect()] == want
    both = x.concat(x)
    assert both.dense and [q.v for q in both.sorted_rows().collect()] == [v for _, v in rows] * 2
    assert x.filter(F.lit(False)).dedupe("v").size() == 0


def test_written_tables_can_be_forgotten(spark):
    x = scratch.cut(spark.range(5), "gone")
    at = x._cut_at
    scratch.forget(x, None, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster())


def test_generated_rows_follow_their_schema(spark):
    from semiflow.operators import records

    shape = "id LONG NOT NULL, n INT, name STRING, who STRUCT<ok: BOOLEAN, x: DOUBLE> NOT NULL"
    x = records.generated(spark, shape, 500, low={"id": 5})
    assert x.columns == ["id", "n", "name", "who"] and x.count() == 500
    r = x.agg(F.min("id").alias("low"), F.count("n").alias("n"), F.min("n").alias("least"), F.countDistinct("name").alias("names"), F.count("who.x").alias("x")).first()
    assert r.low >= 5 and 300 < r.n < 500 and r.least < 0 and r.names > 50 and 300 < r.x < 500
    assert sorted(map(str, x.collect())) == sorted(map(str, records.generated(spark, shape, 500, low={"id": 5}).collect()))
    with pytest.raises(ValueError):
        records.generated(spark, "a ARRAY<INT>")


def test_composed_folds_equal_folds_in_order(spark):
    r = random.Random(2)
    values = [r.randrange(100) for _ in range(3000)]
    x = Flow(spark.createDataFrame(list(enumerate(values)), "k long, v long"), ("k",))
    acc = 5
    for v in values:
        acc = (7 * acc + v) % 10_007

    def rows(own):
        a, b = 1, 0
        for v in own:
            a, b = 7 * a % 10_007, (7 * b + v) % 10_007
        return a, b

    compose = lambda f, g: (f[0] * g[0] % 10_007, (g[0] * f[1] + g[1]) % 10_007)
    assert x.fold_composed(rows, compose, lambda f, s: (f[0] * s + f[1]) % 10_007, 5, "v", "a long, b long").first()[0] == acc
    assert x.filter(F.lit(False)).fold_composed(rows, compose, lambda f, s: s, 5, "v", "a long, b long").first()[0] == 5


def test_some_of_independent_alternatives(spark):
    from semiflow.inference import wmc

    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 0.25), (3, None), (4, 0.0)], "k long, p double")
    got = {x.k: x.p for x in wmc.some_of(df, ["k"], "p").collect()}
    assert abs(got[1] - 0.75) < 1e-12 and got[2] == 1.0 and got[3] == 0.0 and got[4] == 0.0
    many = frozenset(frozenset([f"f{i}"]) for i in range(500))
    assert abs(wmc.count(many, dict.fromkeys((f"f{i}" for i in range(500)), 0.01)) - (1 - 0.99**500)) < 1e-9
