"""Joins, membership and set operations."""

from pyspark.sql import functions as F

from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources.tables import table


def customers(spark, d):
    return Flow(table(spark, d, "customer"))


def orders(spark, d):
    return Flow(table(spark, d, "orders"))


@query("SELECT c_mktsegment, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def revenue_by_segment(spark, d):
    """The flagship: revenue of each market segment. Orders are summed by customer before the join."""
    from semiflow.plans.pushdown import group_sum_through_join

    x = group_sum_through_join(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey"), F.col("o_custkey"), F.col("c_mktsegment"), F.round(F.col("o_totalprice") * 100).cast("long"), "cents")
    return x.withColumnRenamed("group", "c_mktsegment")


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def j1_join(spark, d):
    return customers(spark, d).join(orders(spark, d), F.col("c_custkey"), F.col("o_custkey")).select("l.c_name", "r.o_orderkey")


@query("SELECT a.l_orderkey, a.l_partkey, a.l_linenumber AS la, b.l_linenumber AS lb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber")
def j2_composite_key(spark, d):
    x = Flow(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    key = F.struct("l_orderkey", "l_suppkey")
    y = x.join(x, key, key).filter("l.l_linenumber < r.l_linenumber")
    return y.select("l.l_orderkey", "l.l_partkey", F.col("l.l_linenumber").alias("la"), F.col("r.l_linenumber").alias("lb"))


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'")
def j3_three_way(spark, d):
    c = customers(spark, d).filter(F.col("c_mktsegment") == "BUILDING")
    x = c.join(orders(spark, d), F.col("c_custkey"), F.col("o_custkey")).select("l.c_custkey", "r.o_orderkey")
    y = Flow(x).join(Flow(table(spark, d, "lineitem")), F.col("o_orderkey"), F.col("l_orderkey"))
    return y.select("l.c_custkey", "l.o_orderkey", "r.l_linenumber", "r.l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j4_semijoin(spark, d):
    return customers(spark, d).member_of(orders(spark, d), F.col("c_custkey"), F.col("o_custkey")).map("c_custkey").rows()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 17 = 0)")
def j5_antijoin(spark, d):
    return customers(spark, d).member_of(orders(spark, d).filter(F.col("o_orderkey") % 17 == 0), F.col("c_custkey"), F.col("o_custkey"), absent=True).map("c_custkey").rows()


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
def j7_comprehension_join(spark, d):
    return Flow(table(spark, d, "region")).pairs_with(Flow(table(spark, d, "nation")), F.col("r_regionkey") == F.col("n_regionkey")).map("r_name", "n_name").rows()


@query("SELECT o_orderkey, c_name AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j8_lookup(spark, d):
    return orders(spark, d).lookup(table(spark, d, "customer"), F.col("o_custkey"), "c_custkey", "c_name").map("o_orderkey", "found").rows()


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def j12_product(spark, d):
    return table(spark, d, "region").select("r_regionkey").crossJoin(table(spark, d, "nation").select("n_nationkey"))


@query("SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS total FROM nation")
def j13_own_group(spark, d):
    x = Flow(table(spark, d, "nation").select("n_nationkey", "n_regionkey")).with_own_group("n_regionkey").df
    return x.select("n_nationkey", F.size("group").cast("long").alias("n"), F.aggregate("group", F.lit(0).cast("long"), lambda a, r: a + r["n_nationkey"]).alias("total"))


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def u1_concat(spark, d):
    return orders(spark, d).df.select(F.col("o_orderkey").alias("k")).unionByName(customers(spark, d).df.select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u2_union(spark, d):
    return orders(spark, d).map(F.col("o_custkey").alias("k")).union(customers(spark, d).map(F.col("c_custkey").alias("k"))).rows()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 17 = 0")
def u3_difference(spark, d):
    return customers(spark, d).map(F.col("c_custkey").alias("k")).difference(orders(spark, d).filter(F.col("o_orderkey") % 17 == 0).map(F.col("o_custkey").alias("k"))).rows()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def u3_intersection(spark, d):
    return customers(spark, d).map(F.col("c_custkey").alias("k")).intersection(orders(spark, d).map(F.col("o_custkey").alias("k"))).rows()


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS member, c_mktsegment IN ('BUILDING', 'MACHINERY') AS one_of FROM customer")
def j6_spellings(spark, d):
    """Membership in a relation, and in a set of constants, as a column."""
    c, o = table(spark, d, "customer"), Flow(table(spark, d, "orders"))
    inside = Flow(c.select("c_custkey")).member_of(o, F.col("c_custkey"), F.col("o_custkey")).df.withColumn("member", F.lit(True))
    x = c.join(inside, "c_custkey", "left")
    return x.select("c_custkey", F.coalesce("member", F.lit(False)).alias("member"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("one_of"))
