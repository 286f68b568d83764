"""Folds and aggregations."""

from pyspark.sql import functions as F

from semiflow.functions import monoids, text
from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources.tables import table


def lines(spark, d):
    return Flow(table(spark, d, "lineitem"))


QTY = "CAST(l_quantity AS BIGINT)"


def qty():
    return F.col("l_quantity").cast("long")


@query(f"SELECT CAST(100 + sum({QTY}) AS BIGINT) AS value FROM lineitem")
def a1_reduce(spark, d):
    return lines(spark, d).reduce(F.sum(qty()), 100)


@query("""WITH RECURSIVE x AS (SELECT n_nationkey AS v, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
h AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS value UNION ALL SELECT h.i + 1, (3 * h.value + x.v) % 1000003 FROM h JOIN x ON x.i = h.i + 1)
SELECT value FROM h WHERE i = (SELECT max(i) FROM h)""")
def a1_ordered_fold(spark, d):
    return Flow(table(spark, d, "nation"), ("n_nationkey",)).fold_ordered(lambda a, v: (3 * a + int(v)) % 1000003, 1, "n_nationkey")


@query("""WITH RECURSIVE x AS (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
h AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS value UNION ALL SELECT h.i + 1, (3 * h.value + x.v) % 1000003 FROM h JOIN x ON x.i = h.i + 1)
SELECT value FROM h WHERE i = (SELECT max(i) FROM h)""")
def a1_composed_fold(spark, d):
    """The fold acc -> 3 * acc + v modulo m over a table of any size: its steps are affine, and such functions compose."""
    m = 1_000_003

    def rows(values):
        a, b = 1, 0
        for v in values:
            a, b = 3 * a % m, (3 * b + int(v)) % m
        return a, b

    compose = lambda f, g: (f[0] * g[0] % m, (g[0] * f[1] + g[1]) % m)
    return Flow(table(spark, d, "customer"), ("c_custkey",)).fold_composed(rows, compose, lambda f, acc: (f[0] * acc + f[1]) % m, 1, "c_custkey", "a long, b long")


@query(f"SELECT CAST(7 + sum({QTY}) AS BIGINT) AS value FROM lineitem")
def a3_parallel_fold(spark, d):
    return monoids.fold(lines(spark, d).df, monoids.PLUS, qty(), 7)


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS plus, CAST(max(o_custkey) AS BIGINT) AS top FROM orders")
def a4_apply(spark, d):
    x = Flow(table(spark, d, "orders"))
    return x.apply("+", "o_custkey").toDF("plus").crossJoin(x.apply("max", "o_custkey").toDF("top"))


@query("SELECT CAST(product(n_regionkey + 1) AS BIGINT) AS value FROM nation")
def a4_product(spark, d):
    """Exact, where Spark's own product is a double."""
    return Flow(table(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("x"))).apply("*", "x").select(F.col("value").cast("long").alias("value"))


@query("SELECT c_custkey, length(c_name) AS letters, CAST(2 AS INTEGER) AS entries FROM customer")
def a5_count_kinds(spark, d):
    """Of a string and of a map."""
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.length("c_name").cast("long").alias("letters"), F.size(m).alias("entries"))


@query("SELECT count(*) AS n FROM lineitem")
def a5_count(spark, d):
    return lines(spark, d).count()


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def a5_count_keys(spark, d):
    return Flow(table(spark, d, "orders")).group_by("o_custkey").keys_only().agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem")
def a6_sum(spark, d):
    return lines(spark, d).df.agg(F.sum("l_linenumber").alias("value"))


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def a7_group_by(spark, d):
    x = Flow(table(spark, d, "nation").select("n_regionkey", "n_nationkey")).group_by("n_regionkey").entries()
    return x.select("n_regionkey", F.transform("rows", lambda r: r["n_nationkey"]).alias("keys"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def a8_keys(spark, d):
    return Flow(table(spark, d, "customer")).group_by("c_mktsegment").keys_only()


@query("SELECT list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a8_vals(spark, d):
    x = Flow(table(spark, d, "nation").select("n_regionkey", "n_name")).group_by("n_regionkey").vals()
    return x.select(F.transform("rows", lambda r: r["n_name"]).alias("names"))


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def a8_entries(spark, d):
    x = Flow(table(spark, d, "nation").select("n_regionkey", "n_name")).group_by("n_regionkey").entries()
    return x.select("n_regionkey", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["n_name"].alias("first"))


@query(f"SELECT CAST(sum({QTY}) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def a9_group_aggregate_vals(spark, d):
    return lines(spark, d).group_by("l_suppkey").vals_agg(F.sum(qty()).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a10_frequencies(spark, d):
    return lines(spark, d).frequencies("l_returnflag", "l_linestatus")


@query("SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem")
def a11_distinct(spark, d):
    return lines(spark, d).map("l_suppkey", "l_linenumber").distinct().rows()


@query("SELECT min(event_id) AS event_id, event_type, user_id FROM events GROUP BY event_type, user_id")
def a11_distinct_first(spark, d):
    x = Flow(table(spark, d, "events").select("event_id", "event_type", "user_id"), ("event_id",))
    return x.distinct("event_type", "user_id").rows()


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def a12_keyed_distinct(spark, d):
    return Flow(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ("o_orderkey",)).distinct("o_custkey").rows()


@query("SELECT bool_or(value > 99.9) AS found, bool_and(value >= 0) AS whole FROM events")
def a13_some_every(spark, d):
    x = Flow(table(spark, d, "events"))
    return x.some(F.col("value") > 99.9).toDF("found").crossJoin(x.every(F.col("value") >= 0).toDF("whole"))


@query("SELECT l_suppkey, CAST(max(l_linenumber) AS INTEGER) AS value FROM lineitem GROUP BY l_suppkey")
def a14_aggregate_by(spark, d):
    return monoids.group_by(lines(spark, d).df, monoids.MAX, "l_suppkey", F.col("l_linenumber"))


@query(f"SELECT CAST(sum({QTY} * {QTY}) AS BIGINT) AS value FROM lineitem")
def a15_fold_map(spark, d):
    return monoids.fold(lines(spark, d).df, monoids.PLUS, qty() * qty())


@query(f"SELECT l_suppkey, CAST(sum({QTY}) AS BIGINT) AS value FROM lineitem GROUP BY l_suppkey")
def a16_group_by_monoid(spark, d):
    return monoids.group_by(lines(spark, d).df, monoids.PLUS, "l_suppkey", qty())


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def a17_frequencies(spark, d):
    return Flow(table(spark, d, "orders")).frequencies("o_orderpriority")


@query(f"SELECT l_suppkey, bit_or({QTY}) AS value FROM lineitem GROUP BY l_suppkey")
def a18_bit_or(spark, d):
    return monoids.group_by(lines(spark, d).df, monoids.BIT_OR, "l_suppkey", qty())


@query(f"SELECT l_suppkey, CAST(sum({QTY}) % 97 AS BIGINT) AS value FROM lineitem GROUP BY l_suppkey")
def a18_custom_monoid(spark, d):
    m = monoids.foreign("plus-mod-97", 0, lambda a, b: (int(a) + int(b)) % 97, {"associative", "commutative"})
    return monoids.merge_by(lines(spark, d).df.select("l_suppkey", (qty() % 97).alias("value")), m, "l_suppkey", "value")


@query("SELECT event_type, max(value) AS value FROM events GROUP BY event_type")
def a18_custom_monoid_of_doubles(spark, d):
    m = monoids.foreign("larger", 0.0, max, {"associative", "commutative", "idempotent"})
    return monoids.group_by(table(spark, d, "events"), m, "event_type", F.col("value"))


@query("SELECT o_orderstatus, min(o_orderpriority) AS value FROM orders GROUP BY o_orderstatus")
def a18_custom_monoid_of_strings(spark, d):
    m = monoids.foreign("first word", "~", min, {"associative", "commutative", "idempotent"})
    return monoids.group_by(table(spark, d, "orders"), m, "o_orderstatus", F.col("o_orderpriority"))


@query(f"SELECT l_partkey, CAST(sum({QTY}) AS BIGINT) AS total, min({QTY}) AS low, max({QTY}) AS high FROM lineitem GROUP BY l_partkey")
def a19_group_sum_min_max(spark, d):
    return lines(spark, d).group_by("l_partkey").agg(F.sum(qty()).alias("total"), F.min(qty()).alias("low"), F.max(qty()).alias("high"))


@query(f"SELECT s_nationkey, CAST(sum({QTY}) AS BIGINT) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def a20_star(spark, d):
    return lines(spark, d).df.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum(qty()).alias("total"))


@query(f"SELECT l_suppkey, CAST(sum({QTY}) AS BIGINT) AS total FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 GROUP BY l_suppkey")
def a21_filtered_group_fold(spark, d):
    q = F.col("l_quantity")
    return lines(spark, d).filter((q >= 10) & (q < 30)).group_by("l_suppkey").agg(F.sum(qty()).alias("total"))


@query("SELECT round(sum(value), 4) AS s1, round(sum(value * value), 2) AS s2 FROM events")
def a22_float_sums(spark, d):
    v = F.col("value")
    return table(spark, d, "events").agg(F.round(F.sum(v), 4).alias("s1"), F.round(F.sum(v * v), 2).alias("s2"))


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS value FROM nation")
def t5_concat_fold(spark, d):
    return text.concat_rows(table(spark, d, "nation"), "n_name", "n_nationkey")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def a24_rollup(spark, d):
    return lines(spark, d).df.rollup("l_returnflag", "l_linestatus").agg(F.sum(qty()).alias("total"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(f"SELECT l_orderkey, l_linenumber, {QTY} * 3 + 1 AS value FROM lineitem")
def f1_foreign_function(spark, d):
    """A function from outside, applied to whole Arrow batches."""
    import pandas as pd

    @F.pandas_udf("long")
    def outside(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    return lines(spark, d).df.select("l_orderkey", "l_linenumber", outside(qty()).alias("value"))


@query("SELECT l_suppkey, bit_xor(l_partkey) AS value FROM lineitem GROUP BY l_suppkey")
def f3_registered_monoid(spark, d):
    return monoids.group_by(lines(spark, d).df, monoids.REGISTRY["bit-xor"], "l_suppkey", F.col("l_partkey"))
