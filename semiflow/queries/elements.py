"""Sources, projections, element transforms and predicates."""

from pyspark.sql import functions as F

from semiflow.functions import optional
from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources import tables
from semiflow.sources.tables import table
from semiflow.streaming import structured


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s1_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT CAST(range AS BIGINT) AS value FROM range(1000)")
def s2_range(spark, d):
    return tables.numbers(spark, 1000)


@query("SELECT CAST(range * range AS BIGINT) AS value FROM range(50)")
def s3_endless_range_taken(spark, d):
    """A window of a stream without end."""
    x = structured.take(structured.endless(spark, 20), 50)
    return Flow(x).map((F.col("value") * F.col("value")).alias("value")).rows()


@query("SELECT CAST(range AS BIGINT) AS _pos, CAST(1 << range AS BIGINT) AS value FROM range(10)")
def s4_unfold(spark, d):
    return tables.unfolded(spark, lambda s: (s, 2 * s) if s < 1000 else None, 1, 20, "value long")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def s5_query_as_source(spark, d):
    x = tables.query(spark, "SELECT c_nationkey AS k, c_custkey FROM {c}", c=table(spark, d, "customer"))
    return x.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, p_size * 2 AS doubled FROM part WHERE p_size > 10")
def s6_columnar_query(spark, d):
    return tables.query(spark, "SELECT p_partkey AS k, p_size * 2 AS doubled FROM {p} WHERE p_size > 10", p=table(spark, d, "part"))


@query("SELECT c_custkey AS e, c_name, c_mktsegment FROM customer")
def s10_entity_join(spark, d):
    t = tables.triples(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return tables.entity_join(t, "c_name", "c_mktsegment")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def s11_decorrelated(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 40 AND l_linenumber = 2")
def s12_predicates(spark, d):
    x = tables.where(table(spark, d, "lineitem"), ("l_quantity", ">", 10), ("l_quantity", "<=", 40), ("l_linenumber", "=", 2))
    return x.select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem")
def s13_fold_sinks(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def s13_limit_sink(spark, d):
    x = Flow(table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down")), ("down", "o_orderkey"))
    return x.take(10).df.select("o_orderkey", "o_totalprice")


@query("SELECT list(r_name ORDER BY r_regionkey) AS vector FROM region")
def s13_vector_sink(spark, d):
    return Flow(table(spark, d, "region"), ("r_regionkey",)).partition_all(0, "r_name", "vector").rows()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def s13_set_sink(spark, d):
    return Flow(table(spark, d, "orders")).map("o_orderstatus", "o_orderpriority").distinct().rows()


@query("SELECT c_custkey AS e, c_mktsegment FROM customer")
def s14_attribute_scan(spark, d):
    return tables.attribute(tables.triples(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"), "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 2 + 1 AS value FROM lineitem")
def p1_map(spark, d):
    return Flow(table(spark, d, "lineitem")).map("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 2 + 1).alias("value")).rows()


@query("SELECT c_name FROM customer")
def p2_field(spark, d):
    return Flow(table(spark, d, "customer")).map("c_name").rows()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0")
def p3_filter(spark, d):
    return Flow(table(spark, d, "orders")).filter((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0)).map("o_orderkey").rows()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p4_filter_set(spark, d):
    return Flow(table(spark, d, "customer")).filter_in("c_mktsegment", {"BUILDING", "MACHINERY"}).map("c_custkey").rows()


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def p5_remove(spark, d):
    return Flow(table(spark, d, "events")).remove(F.col("value") > 50).map("event_id").rows()


@query("SELECT o_orderkey + k.range AS value FROM orders, range(3) AS k")
def p6_mapcat(spark, d):
    return Flow(table(spark, d, "orders")).mapcat(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("o_orderkey") + i)).rows()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 + o_custkey AS value FROM orders")
def p7_map_indexed(spark, d):
    x = Flow(table(spark, d, "orders"), ("o_orderkey",)).indexed()
    return x.df.select((F.col("_pos") + F.col("o_custkey")).alias("value"))


@query("SELECT CAST(l_quantity AS BIGINT) // 2 AS value FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 2 = 0")
def p8_filter_map(spark, d):
    q = F.col("l_quantity").cast("long")
    return Flow(table(spark, d, "lineitem")).keep(F.when(q % 2 == 0, F.call_function("div", q, F.lit(2)))).rows()


@query("SELECT n_regionkey + k.range AS value FROM nation, range(2) AS k")
def p9_flatten(spark, d):
    x = table(spark, d, "nation").select(F.array(F.array("n_regionkey"), F.array(F.col("n_regionkey") + 1)).alias("a"))
    return Flow(x).mapcat(F.flatten("a")).map(F.col("value").cast("long").alias("value")).rows()


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND n_nationkey > 3")
def p10_comprehension(spark, d):
    r, n = Flow(table(spark, d, "region")), Flow(table(spark, d, "nation")).filter(F.col("n_nationkey") > 3)
    return r.pairs_with(n, F.col("r_regionkey") == F.col("n_regionkey")).map("r_name", "n_name").rows()


@query("SELECT o_custkey * 2 AS value FROM orders WHERE (o_custkey * 2) % 3 = 0")
def p11_stages(spark, d):
    x = Flow(table(spark, d, "orders")).map((F.col("o_custkey") * 2).alias("value"))
    return x.filter(F.col("value") % 3 == 0).remove(F.col("value") < 0).rows()


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def p14_cond(spark, d):
    b = F.col("c_acctbal")
    return Flow(table(spark, d, "customer")).map("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band")).rows()


@query("SELECT p_partkey, p_size = 10 AS eq, p_size < 10 AS lt, p_size >= 10 AS ge FROM part")
def p15_comparisons(spark, d):
    s = F.col("p_size")
    return Flow(table(spark, d, "part")).map("p_partkey", s.eqNullSafe(10).alias("eq"), (s < 10).alias("lt"), (s >= 10).alias("ge")).rows()


@query("SELECT p_partkey, NOT (p_size > 20) AS value FROM part")
def p16_not(spark, d):
    return Flow(table(spark, d, "part")).map("p_partkey", (~(F.col("p_size") > 20)).alias("value")).rows()


@query("""SELECT c_custkey, coalesce(n.k, -1) AS orders_or_none, n.k IS NULL AS absent, coalesce(n.k + 1, 0) AS bumped FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) n ON c_custkey = n.o_custkey""")
def p17_option(spark, d):
    n = Flow(table(spark, d, "orders")).frequencies("o_custkey")
    x = Flow(table(spark, d, "customer")).lookup(n, F.col("c_custkey"), "o_custkey", "n", "k").df
    k = F.col("k")
    return x.select("c_custkey", optional.or_else(k, F.lit(-1)).alias("orders_or_none"), optional.absent(k).alias("absent"), optional.elim(k, F.lit(0), lambda v: v + 1).alias("bumped"))


@query("SELECT (SELECT count(*) FROM nation) AS scalar, (SELECT count(*) FROM region) AS coll, (SELECT min(n_name) FROM nation) AS tuple")
def s9_find_shapes(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    one = tables.shaped(n.agg(F.count("*")), "scalar")
    many = len(tables.shaped(r.select("r_name"), "coll"))
    pair = tables.shaped(n.orderBy("n_name").select("n_name", "n_nationkey").limit(1), "tuple")
    return spark.createDataFrame([(one, many, pair[0])], "scalar long, coll long, tuple string")


@query("SELECT o_orderkey, o_custkey + o_orderkey AS total, 2 * (o_custkey + 1) AS composed FROM orders")
def p13_functions(spark, d):
    """Functions of columns composed, applied in part, and taking a pair apart."""
    add, double = (lambda a, b: a + b), (lambda v: 2 * v)
    bumped = lambda v: add(v, 1)
    pair = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    x = Flow(table(spark, d, "orders")).map("o_orderkey", pair.alias("p"))
    return x.map("o_orderkey", add(F.col("p")["a"], F.col("p")["b"]).alias("total"), double(bumped(F.col("p")["a"])).alias("composed")).rows()
