"""Semiring-annotated relations, recursion over them, distributions, model counting, lenses."""

from pyspark.sql import functions as F

from semiflow.inference import dist, lens, semiring, wmc
from semiflow.queries import query
from semiflow.scratch import cut
from semiflow.sources.tables import table
from semiflow.streaming import zset

#: All distinct supplier-part links: their least line number as cost, and how often they occur.
E = "SELECT l_suppkey AS a, l_partkey AS b, CAST(min(l_linenumber) AS DOUBLE) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2"

#: edges() has each link once.
UNIQUE = frozenset({"e"})


def tasks(spark, d):
    """By the table's rows, so that a task groups no more of a larger table."""
    return semiring.tasks_for(table(spark, d, "lineitem").count())


def edges(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_linenumber")
    return x.repartition(tasks(spark, d), "a", "b").groupBy("a", "b").agg(F.min("l_linenumber").cast("double").alias("c"), F.count("*").alias("n"))


def rel(spark, d, s, value=None):
    x = edges(spark, d)
    return x.select("a", "b", (s.one() if value is None else F.col(value)).alias("_s"))


def two_hop(spark, d, s, value=None):
    e = cut(rel(spark, d, s, value), "links")
    return semiring.query(["x", "z"], [("e", "x", "y"), ("e", "y", "z")], s, {"e": e}, UNIQUE)


@query(f"WITH e AS ({E}) SELECT x.a AS x, y.b AS z, CAST(sum(x.n * y.n) AS BIGINT) AS s FROM e x JOIN e y ON x.b = y.a GROUP BY 1, 2")
def q4_two_hop_counting(spark, d):
    return two_hop(spark, d, semiring.COUNTING, "n").withColumnRenamed("_s", "s")


@query(f"WITH e AS ({E}) SELECT x.a AS x, y.b AS z, min(x.c + y.c) AS s FROM e x JOIN e y ON x.b = y.a GROUP BY 1, 2")
def q4_two_hop_tropical(spark, d):
    return two_hop(spark, d, semiring.TROPICAL, "c").withColumnRenamed("_s", "s")


@query(f"WITH e AS ({E}) SELECT DISTINCT x.a AS x, y.b AS z, true AS s FROM e x JOIN e y ON x.b = y.a")
def q5_two_hop_existence(spark, d):
    return two_hop(spark, d, semiring.EXISTENCE).withColumnRenamed("_s", "s")


@query(f"WITH e AS ({E}) SELECT x.a AS x, y.b AS z, max(least(x.c / 10, y.c / 10)) AS s FROM e x JOIN e y ON x.b = y.a GROUP BY 1, 2")
def q1_fuzzy(spark, d):
    e = cut(edges(spark, d).select("a", "b", (F.col("c") / 10).alias("_s")), "links")
    return semiring.query(["x", "z"], [("e", "x", "y"), ("e", "y", "z")], semiring.FUZZY, {"e": e}, UNIQUE).withColumnRenamed("_s", "s")


@query(f"WITH e AS ({E}) SELECT x.a AS x, round(sum(x.c / 10 * (y.c / 10)), 6) AS s FROM e x JOIN e y ON x.b = y.a GROUP BY 1")
def q1_probability(spark, d):
    e = edges(spark, d).select("a", "b", (F.col("c") / 10).alias("_s"))
    x = semiring.query(["x"], [("e", "x", "y"), ("e", "y", "z")], semiring.PROBABILITY, {"e": e}, UNIQUE, tasks(spark, d))
    return x.select("x", F.round("_s", 6).alias("s"))


@query("SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1")
def q1_provenance(spark, d):
    x = semiring.fact(table(spark, d, "nation").select("n_regionkey", "n_name"), F.col("n_name"))
    y = semiring.marginal(x, ["n_regionkey"], semiring.PROVENANCE)
    return y.select("n_regionkey", F.array_sort(F.flatten("_s")).alias("names"))


@query(f"WITH e AS ({E}) SELECT a, b, CAST(sum(n) AS BIGINT) AS s FROM (SELECT a, b, n FROM e UNION ALL SELECT b, a, n FROM e) GROUP BY 1, 2")
def q2_add(spark, d):
    x = rel(spark, d, semiring.COUNTING, "n")
    return semiring.add(x, x.select(F.col("b").alias("a"), F.col("a").alias("b"), "_s"), semiring.COUNTING, 2 * tasks(spark, d)).withColumnRenamed("_s", "s")


@query("SELECT r_regionkey, n_nationkey, CAST(6 AS BIGINT) AS s FROM region, nation")
def q2_mul(spark, d):
    x = table(spark, d, "region").select("r_regionkey", F.lit(2).cast("long").alias("_s"))
    y = table(spark, d, "nation").select("n_nationkey", F.lit(3).cast("long").alias("_s"))
    return semiring.mul(x, y, semiring.COUNTING).withColumnRenamed("_s", "s")


@query(f"WITH e AS ({E}) SELECT a, CAST(sum(n) AS BIGINT) AS s FROM e GROUP BY 1")
def q2_rel_sum(spark, d):
    return semiring.marginal(rel(spark, d, semiring.COUNTING, "n"), ["a"], semiring.COUNTING).withColumnRenamed("_s", "s")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q3_factors(spark, d):
    s, one = semiring.COUNTING, F.lit(1).cast("long").alias("_s")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment", one)
    o = semiring.renamed(table(spark, d, "orders").select("o_custkey", "o_orderkey", one), o_custkey="cust", o_orderkey="order")
    li = semiring.marginal(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), one), ["order"], s)
    return semiring.eliminate([c, o, li], ["c_mktsegment"], s).withColumnRenamed("_s", "s")


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey AS b, min(o_totalprice) AS c FROM orders GROUP BY 1, 2),
r(a, b, s) USING KEY (a, b) AS (SELECT a, b, c FROM e UNION (SELECT r.a, e.b, min(r.s + e.c) FROM r JOIN e ON r.b = e.a LEFT JOIN recurring.r AS k ON k.a = r.a AND k.b = e.b
WHERE k.s IS NULL OR r.s + e.c < k.s GROUP BY r.a, e.b)) SELECT a, b, s FROM r""")
def q6_shortest_paths(spark, d):
    """Cheapest paths over all customer-order links."""
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).agg(F.min("o_totalprice").cast("double").alias("_s"))
    return semiring.closure(e, semiring.TROPICAL).withColumnRenamed("_s", "s")


@query("SELECT n_regionkey, round(1 - power(0.5, count(*)), 9) AS p FROM nation GROUP BY 1")
def q8_model_count(spark, d):
    x = semiring.fact(table(spark, d, "nation").select("n_regionkey", "n_name"), F.col("n_name"))
    y = semiring.marginal(x, ["n_regionkey"], semiring.PROVENANCE)
    return y.select("n_regionkey", F.round(wmc.weighted(0.5)(F.col("_s")), 9).alias("p"))


@query("SELECT o_custkey, round(1 - exp(sum(ln(1 - 1 / (2 + o_orderkey % 7)))), 9) AS p FROM orders GROUP BY 1")
def q8_independent_alternatives(spark, d):
    """That some order of each customer holds, all being independent: an aggregate, for groups of any size."""
    p = 1 / (2 + F.col("o_orderkey") % 7)
    return wmc.some_of(table(spark, d, "orders").select("o_custkey", p.alias("p")), ["o_custkey"], "p").select("o_custkey", F.round("p", 9).alias("p"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(avg(CASE WHEN l_quantity > 40 THEN 1.0::DOUBLE ELSE 0 END), 6) AS large FROM lineitem")
def q9_expectation(spark, d):
    x = dist.uniform(table(spark, d, "lineitem"), "l_quantity")
    big = dist.probability(x, F.col("outcome") > 40)
    return dist.expectation(x, F.col("outcome")).select(F.round("value", 6).alias("mean")).crossJoin(big.select(F.round("value", 6).alias("large")))


@query("SELECT n_regionkey AS outcome, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM customer), 9) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q9_bind(spark, d):
    x = dist.uniform(table(spark, d, "customer"), "c_nationkey")
    k = table(spark, d, "nation").select(F.col("n_nationkey").alias("given"), F.col("n_regionkey").alias("outcome"), F.lit(1.0).alias("q"))
    return dist.bind(x, k).select("outcome", F.round("p", 9).alias("p"))


@query("SELECT 1.0::DOUBLE AS uniform, 13.0::DOUBLE AS gaussian, 4.0::DOUBLE AS finite")
def q10_sampling(spark, d):
    """Sampled means, rounded as far as so many draws tell, beside the true ones."""
    u = dist.sampled(spark, dist.uniform_draw(0, 2), lambda x: x).select(F.round("value", 1).alias("uniform"))
    g = dist.sampled(spark, dist.gaussian_draw(3, 2), lambda x: x * x).select(F.round("value", 0).alias("gaussian"))
    f = dist.sampled(spark, dist.finite_draw({1: 1.0, 5: 3.0}), lambda x: x).select(F.round("value", 1).alias("finite"))
    return u.crossJoin(g).crossJoin(f)


@query("SELECT o_orderkey, true AS ok, o_custkey + 1 AS v FROM orders")
def q11_lens(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.struct(F.struct("o_custkey").alias("who")).alias("r"))
    at = lens.key("who").then(lens.key("o_custkey"))
    new = at.get(F.col("r")) + 1
    return x.select("o_orderkey", lens.round_trips(at, F.col("r"), new).alias("ok"), at.get(at.put(F.col("r"), new)).alias("v"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CAST(1 AS BIGINT) AS w FROM customer")
def q11_delta_lens(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    edits = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("value"))
    return zset.add(zset.zset(c), lens.field_edit(c, "c_custkey", "c_mktsegment", edits)).withColumnRenamed("_w", "w")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS s, true AS same FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q7_elimination_equals_plain(spark, d):
    """Sums after elimination beside those of the whole join."""
    s, one = semiring.COUNTING, F.lit(1).cast("long").alias("_s")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", one)
    o = semiring.marginal(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), one), ["k"], s)
    fast = semiring.eliminate([c, o], ["c_mktsegment"], s)
    plain = semiring.marginal(semiring.join(c, o, s), ["c_mktsegment"], s).withColumnRenamed("_s", "p")
    return fast.join(plain, "c_mktsegment").select("c_mktsegment", F.col("_s").alias("s"), (F.col("_s") == F.col("p")).alias("same"))
