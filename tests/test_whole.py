"""Queries over whole tables, without a filter or a fold of keys."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = entry.queries()


def paths(links):
    """Cheapest cost of each pair that a path joins."""
    best = dict(links)
    while True:
        new = dict(best)
        for (a, b), s in best.items():
            for (x, y), c in links.items():
                if x == b and s + c < new.get((a, y), float("inf")):
                    new[a, y] = s + c
        if new == best:
            return best
        best = new


def test_closures_take_all_links(spark, tmp_path):
    r = random.Random(3)
    links = {(r.randrange(1, 9), o): float(r.randrange(1000, 2000)) for o in range(1, 41)}
    spark.createDataFrame([(a, b, c) for (a, b), c in links.items()], "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = paths(links)
    assert any(s > 6 for s in want.values()) and len(want) > len(links)
    assert {(x.a, x.b): x.s for x in QUERIES["q6_shortest_paths"](spark, str(tmp_path)).collect()} == want
    assert {(x.a, x.b) for x in QUERIES["i19_reachability"](spark, str(tmp_path)).collect()} == set(want)


def test_relations_take_every_row(spark, sf):
    x = QUERIES["q2_rel_sum"](spark, sf).collect()
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert sum(r.s for r in x) == items.count() and len(x) == items.select("l_suppkey").distinct().count()


def test_deltas_take_every_row(spark, sf):
    events, orders = spark.read.parquet(f"{sf}/events.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    assert -sum(r.w for r in QUERIES["i2_negate"](spark, sf).collect()) == events.count()
    assert QUERIES["i18_net_cardinality"](spark, sf).first().value == -events.count()
    of = orders.join(spark.read.parquet(f"{sf}/customer.parquet"), orders.o_custkey == F.col("c_custkey"))
    last = {r.step: r.value for r in QUERIES["i23_running_join_count"](spark, sf).collect()}
    assert len(last) == 4 and last[3] == of.count()
