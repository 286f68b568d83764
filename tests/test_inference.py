import math
import random

import pytest
from pyspark.sql import functions as F

from semiflow.functions import monoids
from semiflow.inference import dist, semiring, wmc
from semiflow.operators import records
from semiflow.sources import tables
from semiflow.streaming import fixpoint


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2, 5.0), (1, 3, 2.0), (2, 9, 1.0), (3, 9, 4.0)], "a long, b long, c double")


def two_hop(e, s):
    return semiring.query(["x", "z"], [("e", "x", "y"), ("e", "y", "z")], s, {"e": e}).collect()


def test_two_hops(edges):
    e = edges.select("a", "b", F.lit(1).cast("long").alias("_s"))
    assert [tuple(r) for r in two_hop(e, semiring.COUNTING)] == [(1, 9, 2)]
    assert [tuple(r) for r in two_hop(edges.withColumnRenamed("c", "_s"), semiring.TROPICAL)] == [(1, 9, 6.0)]
    assert [tuple(r) for r in two_hop(edges.select("a", "b", F.lit(True).alias("_s")), semiring.EXISTENCE)] == [(1, 9, True)]


def test_order_of_elimination_does_not_matter(spark):
    r = random.Random(2)
    f = [spark.createDataFrame([(r.randrange(3), r.randrange(3), r.randrange(5)) for _ in range(12)], f"{a} long, {b} long, v long") for a, b in ("xy", "yz", "zw")]
    f = [semiring.annotated(x.drop("v"), semiring.COUNTING) for x in f]
    got = [sorted(map(tuple, semiring.eliminate(f, ["x"], semiring.COUNTING, o).collect())) for o in (None, ["y", "z", "w"], ["w", "z", "y"], ["z", "y", "w"])]
    assert all(g == got[0] for g in got)


def test_recursion_only_where_it_rests(spark, edges):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 9.0)], "a long, b long, _s double")
    got = {(r.a, r.b): r._s for r in semiring.closure(e, semiring.TROPICAL).collect()}
    assert len(got) == 16 and got[1, 4] == 3 and got[4, 4] == 12
    for s in (semiring.COUNTING, semiring.PROBABILITY, semiring.PROVENANCE):
        with pytest.raises(semiring.NotSafe):
            semiring.closure(e, s)


def test_model_counting(spark):
    e = semiring.fact(spark.createDataFrame([("1", "2"), ("2", "3"), ("2", "4"), ("3", "9"), ("4", "9")], "a string, b string"), F.concat("a", F.lit(">"), "b"))
    r = {"e": e}
    got = semiring.query(["x", "z"], [("e", "x", "p"), ("e", "p", "q"), ("e", "q", "z")], semiring.PROVENANCE, r)
    row = got.select("x", "z", wmc.weighted(0.5)(F.col("_s")).alias("p")).first()
    assert (row.x, row.z) == ("1", "9") and math.isclose(row.p, 0.21875)
    two = frozenset({frozenset("ab"), frozenset("cd")})
    assert math.isclose(wmc.count(two, {"a": 0.9, "b": 0.8, "c": 0.5, "d": 0.4}), 0.776)
    rnd = random.Random(1)
    for _ in range(60):
        dnf = frozenset(frozenset(rnd.sample("abcdefg", rnd.randint(1, 4))) for _ in range(rnd.randint(0, 6)))
        p = {x: rnd.random() for x in "abcdefg"}
        assert math.isclose(wmc.count(dnf, p), wmc.enumerated(dnf, p), abs_tol=1e-9)
    with pytest.raises(Exception, match="at most 1"):
        got.select(wmc.weighted(0.5, most=1)(F.col("_s"))).collect()


def test_distributions(spark):
    d = dist.finite(spark, {1: 0.5, 2: 0.25, 3: 0.25})
    assert dist.expectation(d, F.col("outcome")).first()[0] == 1.75 and dist.probability(d, F.col("outcome") > 1).first()[0] == 0.5
    assert {r.outcome: r.p for r in dist.mapped(d, F.col("outcome") % 2).collect()} == {1: 0.75, 0: 0.25}
    assert {r.outcome: r.p for r in dist.bernoulli(spark, 0.25).collect()} == {True: 0.25, False: 0.75}
    assert dist.normalized(dist.finite(spark, {"a": 1.0, "b": 3.0})).filter("outcome = 'b'").first().p == 0.75


@pytest.mark.parametrize("name", ["counting", "tropical", "min-max-prob", "existence", "provenance"])
def test_composed_equals_join_and_sum(spark, monkeypatch, name):
    for k, v in (("ROWS", 20), ("PRODUCTS", 50), ("PER_BLOCK", 7)):
        monkeypatch.setattr(semiring, k, v)
    s, r = semiring.ALL[name], random.Random(name)
    value = {"counting": F.col("n"), "tropical": F.col("n").cast("double"), "min-max-prob": F.col("n") / 10, "existence": F.lit(True), "provenance": F.array(F.array(F.col("n").cast("string")))}[name]

    def rel(seed, *cols):
        rows = {tuple(r.choice([None, *range(8)]) for _ in cols) for _ in range(60)} | {(*[1] * (len(cols) - 1), z) for z in range(30)} | {(z, *[1] * (len(cols) - 1)) for z in range(30)}
        df = spark.createDataFrame([(*x, r.randrange(1, 9)) for x in sorted(rows, key=str)], f"{', '.join(f'{c} long' for c in cols)}, n long")
        return df.select(*cols, value.alias("_s"))

    shown = lambda df: sorted(str(sorted(x.asDict().items())) for x in df.collect())
    for a, b in ((rel(1, "x", "y"), rel(2, "y", "z")), (rel(3, "x", "y", "w"), rel(4, "y", "w", "z"))):
        keep = [c for c in ("x", "w", "z") if c in a.columns + b.columns]
        want = semiring.marginal(semiring.join(a, b, s), keep, s)
        assert shown(semiring.composed(a, b, "y", s).select(*keep, "_s")) == shown(want) and want.count() > 100
        # Products are summed where they are made.
        assert "Exchange" not in semiring.composed(a, b, "y", s)._jdf.queryExecution().executedPlan().toString().split("Generate inline")[0]
        assert shown(semiring.eliminate([a, b], keep, s)) == shown(want)
    assert semiring.composed(a.limit(0), b, "y", s).count() == 0


def test_tasks_grow_with_rows(spark, monkeypatch, sf):
    """So that a task groups no more rows of larger tables."""
    from semiflow.queries import annotated

    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(semiring, "ROWS", n // 10)
    t = annotated.tasks(spark, sf)
    assert t >= 10 and annotated.edges(spark, sf).rdd.getNumPartitions() == t and annotated.q2_add(spark, sf).rdd.getNumPartitions() == 2 * t
    e = annotated.rel(spark, sf, semiring.COUNTING, "n")
    one_end = semiring.query(["x"], [("e", "x", "y"), ("e", "y", "z")], semiring.COUNTING, {"e": e}, annotated.UNIQUE, 77)
    assert "hashpartitioning(y" in (plan := one_end._jdf.queryExecution().executedPlan().toString()) and ", 77), REPARTITION_BY_NUM" in plan


def brute_closure(links, add, mul):
    best, changed = dict(links), True
    while changed:
        changed = False
        for (a, b), s in list(best.items()):
            for (x, y), c in links.items():
                if x == b:
                    v = mul(s, c) if (a, y) not in best else add(best[a, y], mul(s, c))
                    changed |= best.get((a, y)) != v
                    best[a, y] = v
    return best


@pytest.mark.parametrize("shape", ["sparse", "dense", "tree", "ring", "lasso"])
def test_closures_of_random_links(spark, shape):
    r = random.Random(shape)
    links = {
        "sparse": lambda: {(r.randrange(40), r.randrange(40)): float(r.randrange(1, 50)) for _ in range(60)},
        "dense": lambda: {(r.randrange(14), r.randrange(14)): float(r.randrange(1, 50)) for _ in range(70)},
        "tree": lambda: {(r.randrange(max(1, i // 2)), i): float(i) for i in range(1, 60)} | {(r.randrange(20), 70 + r.randrange(5)): 3.0 for _ in range(12)},
        "ring": lambda: {(i, (i + 1) % 30): float(i + 1) for i in range(30)},
        "lasso": lambda: {(i, (i + 1) % 5): float(i + 1) for i in range(5)} | {(r.randrange(5), i): float(i) for i in range(5, 60)} | {(r.randrange(60), i): 2.0 for i in range(60, 70)},
    }[shape]()
    e = spark.createDataFrame([(a, b, c) for (a, b), c in links.items()], "a long, b long, _s double")
    for s, add, mul in ((semiring.TROPICAL, min, lambda x, y: x + y), (semiring.FUZZY, max, min)):
        rows = semiring.closure(e, s).collect()
        assert len(rows) == len({(x.a, x.b) for x in rows})
        assert {(x.a, x.b): x._s for x in rows} == brute_closure(links, add, mul)


def test_closures_of_long_chains_take_few_rounds(spark):
    """Jobs grow with the logarithm of the longest path."""
    n, sc = 300, spark.sparkContext
    e = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"), F.lit(1.0).alias("_s"))
    sc.setJobGroup("chain", "chain")
    x = semiring.closure(e, semiring.TROPICAL)
    assert x.count() == n * n and x.agg(F.max("_s")).first()[0] == n
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 150
    sc.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(semiring.NotSafe):
        semiring.closure(e.withColumn("_s", F.lit(-1.0)), semiring.TROPICAL, max_rounds=1000)


def test_links_of_null_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, None), (None, 1), (1, None), (None, None)], "a long, b long")
    want = {(a, b) for a in (1, 2, None) for b in (1, 2, None)}
    assert sorted(map(str, fixpoint.reachable(e).collect())) == sorted(f"Row(a={a}, b={b})" for a, b in want)


def test_monoid_laws():
    for m in monoids.REGISTRY.values():
        samples = {"": ["", "a", "bc"], False: [False, True], True: [False, True]}.get(m.identity) if isinstance(m.identity, (str, bool)) else [0, 1, 2, 5]
        assert monoids.broken_laws(m, samples) == [], m.name
    assert "associative" in monoids.broken_laws(monoids.foreign("minus", 0, lambda a, b: a - b, {"associative"}), [0, 1, 2])


def test_custom_folds_are_split(spark):
    m = monoids.foreign("gcd", 0, lambda a, b: math.gcd(int(a), int(b)), {"associative", "commutative", "idempotent"})
    df = spark.createDataFrame([(i % 3, (i % 3 + 2) * 6 * (i + 1)) for i in range(300)], "k long, v long")
    assert {r.k: r.v for r in monoids.group_by(df, m, "k", F.col("v"), "v").collect()} == {0: 12, 1: 18, 2: 72}
    assert monoids.fold(df, m, F.col("v")).first()[0] == 6 and monoids.fold(df.limit(0), m, F.col("v"), 5).first()[0] == 5
    with pytest.raises(ValueError):
        monoids.fold(df, monoids.TEXT, F.col("k"))


def test_conform_raises(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x long")
    assert records.violations(df, natural=F.col("x") >= 0).first()[0] == 1
    with pytest.raises(Exception, match="a row fails natural"):
        records.conform(df, natural=F.col("x") >= 0).collect()


def test_find_shapes_and_unfold(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    assert tables.shaped(df, "scalar") == 1 and tables.shaped(df, "coll") == [1, 2] and tables.shaped(df, "tuple") == (1, "a") and tables.shaped(df.limit(0), "scalar") is None
    assert [r.value for r in tables.unfolded(spark, lambda s: None if s > 2 else (s * 10, s + 1), 0, 99, "value long").orderBy("_pos").collect()] == [0, 10, 20]
    with pytest.raises(ValueError):
        tables.where(df, ("x", "~", 1))


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, tables.read(spark, f"{tmp_path}/{kind}", kind, "x long, y string").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        tables.read(spark, f"{tmp_path}/json", "json")
