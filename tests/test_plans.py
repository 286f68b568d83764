"""Rewritten aggregates against plain ones, on random rows; facts that license, and their absence."""

import random

import pytest
from pyspark.sql import functions as F

from semiflow.plans import facts, pushdown


@pytest.fixture(scope="module", params=[1, 2, 3])
def sides(request, spark):
    r = random.Random(request.param)
    rows = lambda n: [(r.choice([None, *range(6)]), r.choice([None, *range(-3, 9)]), r.randrange(4)) for _ in range(n)]
    return spark.createDataFrame(rows(40), "k long, v long, g long"), spark.createDataFrame(rows(0 if request.param == 3 else 30), "k2 long, w long, h long")


def test_pushed_equals_plain(sides):
    a, b = sides
    k, k2 = F.col("k"), F.col("k2")
    j = a.join(b, k.eqNullSafe(k2))
    plain = lambda e: j.agg(F.coalesce(F.sum(e), F.lit(0))).first()[0]
    v, w = F.col("v"), F.col("w")
    assert pushdown.count_through_join(a, b, k, k2).first()[0] == j.count()
    assert pushdown.sum_through_join(a, b, k, k2, v, w).first()[0] == plain(v * w)
    assert pushdown.sum_through_join(a, b, k, k2, g=w).first()[0] == plain(w)
    assert pushdown.sum_through_join(a, b, k, k2, v, w, F.col("g") > 1, F.col("h") < 3).first()[0] == j.filter("g > 1 AND h < 3").agg(F.coalesce(F.sum(v * w), F.lit(0))).first()[0]
    assert pushdown.sum_through_join(a, b, k, k2, v, w, of_key=lambda x: x % 3).first()[0] == plain(v * w * (k % 3))
    got = {r.group: r.value for r in pushdown.group_sum_through_join(a, b, k, k2, F.col("g"), w).collect()}
    assert got == {r.g: r.s for r in j.groupBy("g").agg(F.sum("w").alias("s")).collect()}
    assert pushdown.product_of_sums(a, b, v, w).first()[0] == a.crossJoin(b).agg(F.coalesce(F.sum(v * w), F.lit(0))).first()[0]


def test_products_of_sums_beyond_64_bits(spark):
    big, few = spark.createDataFrame([(2**40,)] * 5, "v long"), spark.createDataFrame([(2**30,), (None,), (3,)], "w long")
    v, w = F.col("v"), F.col("w")
    assert int(pushdown.product_of_sums(big, few, v, w).first()[0]) == 5 * 2**40 * (2**30 + 3)
    assert pushdown.product_of_sums(few, few, w, w).dtypes == [("value", "bigint")] and pushdown.product_of_sums(few, few, w, w).first()[0] == (2**30 + 3) ** 2
    huge = spark.createDataFrame([(2**62,)] * 4, "v long")
    assert int(pushdown.product_of_sums(huge, few, v, w * -1).first()[0]) == -(2**64) * (2**30 + 3)
    assert pushdown.product_of_sums(few, few.limit(0), w, w).first()[0] == 0 and pushdown.product_of_sums(few, few, w / 2, w).dtypes == [("value", "double")]


def test_facts_license(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "k long, v long")
    known = facts.Known(df, facts.Facts((facts.Range("v", 0, 10),), (("k",),)))
    assert "dropped" in known.filter_range("v", 0, 10).report() and known.filter_range("v", 0, 10).df is df
    assert "kept" in known.filter_range("v", 6).report() and known.filter_range("v", 6).df.count() == 1
    assert "empty" in known.filter_range("v", 10).report() and known.filter_range("v", 10).df.count() == 0
    assert known.distinct().df is df and known.distinct_by("k", "v").df is df
    assert "kept" in known.distinct_by("v").report() and "kept" in known.project("v").distinct().report()
    assert "dropped" in known.project("k").distinct().report()
    bare = facts.Known(df)
    assert "kept" in bare.filter_range("v", 0, 10).report() and "kept" in bare.distinct().report()
    steps = lambda t: t.filter_range("v", 0, 10).distinct()
    assert {k: len(v) for k, v in facts.unlocked(df, steps, {"none": facts.Facts(), "all": known.facts}).items()} == {"none": 0, "all": 2}


def test_guard_falls_back(spark):
    good, bad = spark.createDataFrame([(1, 5), (2, 7)], "k long, v long"), spark.createDataFrame([(1, 5), (1, 7)], "k long, v long")
    fast, slow = lambda d: d, lambda d: d.groupBy("k").agg(F.sum("v").alias("v"))
    assert facts.guarded(good, ("k",), fast, slow)[1] == "guarded"
    df, how = facts.guarded(bad, ("k",), fast, slow)
    assert how == "fell back" and [tuple(r) for r in df.collect()] == [(1, 12)]
    assert facts.key_candidates(good) == ["k", "v"] and facts.key_candidates(bad) == ["v"]
    assert {r.column: r.ndv for r in facts.profile(bad).collect()} == {"k": 1, "v": 2}
    assert pushdown.worth_pushing(bad, F.col("k")) and not pushdown.worth_pushing(good, F.col("k"))
