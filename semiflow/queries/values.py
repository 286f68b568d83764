"""Maps, records, strings, arithmetic and values of no fixed type."""

from pyspark.sql import functions as F

from semiflow.functions import maps, nat, text, values
from semiflow.operators import records
from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources.tables import table


def order(spark, d):
    """Orders as records with a nested one."""
    x = table(spark, d, "orders")
    return x.select("o_orderkey", F.struct("o_custkey", "o_orderstatus", F.struct("o_orderpriority", F.col("o_custkey").alias("rank")).alias("detail")).alias("r"))


@query("SELECT o_orderkey, 2 AS n, o_custkey AS got, CAST(-1 AS BIGINT) AS missing FROM orders")
def m1_map(spark, d):
    m = maps.put(maps.put(maps.put(maps.empty("string", "bigint"), F.lit("a"), F.lit(1).cast("long")), F.lit("b"), F.lit(2).cast("long")), F.lit("a"), F.col("o_custkey"))
    none = F.lit(-1).cast("long")
    return table(spark, d, "orders").select("o_orderkey", maps.size(m).alias("n"), maps.get(m, F.lit("a"), none).alias("got"), maps.get(m, F.lit("z"), none).alias("missing"))


@query("SELECT n_regionkey, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def m2_map_insert(spark, d):
    """Names inserted by key in the order of names: the last stays."""
    x = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name"))).alias("t"))
    m = F.aggregate("t", maps.empty("string", "string"), lambda m, t: maps.put(m, F.lit("k"), t["n_name"]))
    return x.select("n_regionkey", maps.get(m, F.lit("k"), F.lit("")).alias("last"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def r1_field(spark, d):
    r = F.col("r")
    return order(spark, d).select("o_orderkey", records.field(r, "o_custkey").alias("o_custkey"), records.get_in(r, "detail", "o_orderpriority").alias("o_orderpriority"))


@query("SELECT o_orderkey, CAST(7 AS BIGINT) AS o_custkey, 'X' AS o_orderstatus FROM orders")
def r2_assoc(spark, d):
    r = records.assoc(F.col("r"), o_custkey=F.lit(7).cast("long"), o_orderstatus=F.lit("X"))
    return order(spark, d).select("o_orderkey", r["o_custkey"].alias("o_custkey"), r["o_orderstatus"].alias("o_orderstatus"))


@query("SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders")
def r3_update(spark, d):
    return order(spark, d).select("o_orderkey", records.update(F.col("r"), "o_custkey", nat.inc)["o_custkey"].alias("o_custkey"))


@query("SELECT o_orderkey, o_custkey * 2 AS doubled, CAST(0 AS BIGINT) AS zeroed FROM orders")
def r4_nested(spark, d):
    a = records.update_in(F.col("r"), ("detail", "rank"), lambda v: v * 2)
    b = records.assoc_in(F.col("r"), ("detail", "rank"), F.lit(0).cast("long"))
    return order(spark, d).select("o_orderkey", records.get_in(a, "detail", "rank").alias("doubled"), records.get_in(b, "detail", "rank").alias("zeroed"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def r5_select_keys(spark, d):
    return order(spark, d).select("o_orderkey", records.select_keys(F.col("r"), "o_custkey", "o_orderstatus").alias("k")).select("o_orderkey", "k.*")


@query("SELECT count(*) FILTER (WHERE NOT coalesce(c_custkey >= 0, false)) AS key, count(*) FILTER (WHERE NOT coalesce(c_acctbal >= 0, false)) AS balance FROM customer")
def r6_validate(spark, d):
    return records.violations(table(spark, d, "customer"), key=F.col("c_custkey") >= 0, balance=F.col("c_acctbal") >= 0)


@query("SELECT o_orderkey FROM orders")
def r6_conform(spark, d):
    return records.conform(table(spark, d, "orders"), key=F.col("o_orderkey").isNotNull()).select("o_orderkey")


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS v FROM orders")
def r7_last_write(spark, d):
    r = records.assoc(records.assoc(F.col("r"), o_custkey=F.lit(1).cast("long")), o_custkey=F.lit(2).cast("long"))
    return order(spark, d).select("o_orderkey", r["o_custkey"].alias("v"))


@query("SELECT o_orderkey, o_orderstatus AS v FROM orders")
def r8_positional(spark, d):
    x = order(spark, d)
    return x.select("o_orderkey", records.at(F.col("r"), x, "r", 1).alias("v"))


@query("SELECT c_custkey, c_name || '/' || CAST(c_nationkey AS VARCHAR) AS v FROM customer")
def t1_str(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.text(F.col("c_name"), F.lit("/"), F.col("c_nationkey")).alias("v"))


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low FROM customer")
def t2_case(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"))


@query("SELECT c_custkey, starts_with(c_mktsegment, 'B') AS v FROM customer")
def t3_starts_with(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").startswith("B").alias("v"))


@query("SELECT c_custkey, length(c_name) AS n, length(c_name) AS chars, ascii(c_name) AS code FROM customer")
def t4_length(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.length(n).cast("long").alias("n"), F.size(text.characters(n)).cast("long").alias("chars"), text.code(n).alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS plus, greatest(l_suppkey - l_partkey, 0) AS minus, l_partkey * l_suppkey AS times FROM lineitem")
def n1_arithmetic(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (a + b).alias("plus"), nat.minus(b, a).alias("minus"), (a * b).alias("times"))


@query("SELECT n_nationkey, n_nationkey + 1 AS up, greatest(n_nationkey - 1, 0) AS down FROM nation")
def n2_inc_dec(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", nat.inc(n).alias("up"), nat.dec(n).alias("down"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey ELSE o_orderkey % (o_custkey % 5) END AS m, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey // (o_custkey % 5) END AS q FROM orders")
def n3_mod_quot(spark, d):
    a, b = F.col("o_orderkey"), F.col("o_custkey") % 5
    return table(spark, d, "orders").select("o_orderkey", nat.mod(a, b).alias("m"), nat.quot(a, b).alias("q"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) AS hi, least(l_partkey, l_suppkey) AS lo FROM lineitem")
def n4_max_min(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nat.larger(a, b).alias("hi"), nat.smaller(a, b).alias("lo"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ev, n_nationkey % 2 <> 0 AS od FROM nation")
def n5_even_odd(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", nat.even(n).alias("ev"), nat.odd(n).alias("od"))


@query("SELECT n_nationkey, CAST((n_nationkey - 12) // 5 + CASE WHEN n_nationkey < 12 AND (n_nationkey - 12) % 5 <> 0 AND (n_nationkey - 12) // 5 < (n_nationkey - 12) / 5.0 - 0.99 THEN 1 ELSE 0 END AS BIGINT) AS q, -n_nationkey AS neg, n_nationkey / 4.0::DOUBLE AS f FROM nation")
def n6_signed(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", nat.signed_quot(n - 12, F.lit(5)).alias("q"), (-n).alias("neg"), (n / F.lit(4.0)).alias("f"))


@query("SELECT n_nationkey, ((n_nationkey * 2 + 1) * 3 + 4) * 5 AS v FROM nation")
def n7_affine(spark, d):
    return Flow(table(spark, d, "nation")).map("n_nationkey", (F.col("n_nationkey") * 2 + 1).alias("v")).map("n_nationkey", (F.col("v") * 3 + 4).alias("v")).map("n_nationkey", (F.col("v") * 5).alias("v")).rows()


def doc(spark, d):
    """Orders as JSON texts."""
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.struct(F.lit(True).alias("flag")).alias("more"))).alias("j"))


@query("SELECT o_orderkey, o_custkey AS cust, o_orderstatus AS status, true AS flag FROM orders")
def v1_get(spark, d):
    v = values.value(F.col("j"))
    return doc(spark, d).select("o_orderkey", values.get(v, "cust", "bigint").alias("cust"), values.get(v, "status", "string").alias("status"), values.get(v, "more.flag", "boolean").alias("flag"))


@query("SELECT o_orderkey, true AS i, true AS s, true AS m, false AS x FROM orders")
def v2_types(spark, d):
    v = values.value(F.col("j"))
    part = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    return doc(spark, d).select("o_orderkey", values.is_type(part("cust"), "int").alias("i"), values.is_type(part("status"), "string").alias("s"), values.is_type(part("more"), "map").alias("m"), values.is_type(part("cust"), "string").alias("x"))


@query("SELECT o_orderkey, o_custkey AS cust FROM orders")
def v3_round_trip(spark, d):
    back = values.to_json(values.value(F.col("j")))
    return doc(spark, d).select("o_orderkey", F.get_json_object(back, "$.cust").cast("long").alias("cust"))


@query("SELECT CAST(0 AS BIGINT) AS broken, true AS found")
def f17_checked(spark, d):
    """A claim that holds of all generated rows, and one that doesn't."""
    shape = "cid LONG NOT NULL, amount LONG NOT NULL"
    capped = lambda df: df.select("cid", "amount", F.least("amount", F.lit(50)).alias("capped"))
    ok = records.counterexamples(spark, shape, capped, (F.col("capped") <= 50) & (F.col("capped") <= F.col("amount")), low={"amount": 0})
    no = records.counterexamples(spark, shape, capped, F.col("capped") == F.col("amount"), low={"amount": 0})
    return ok.agg(F.count("*").alias("broken")).crossJoin(no.agg((F.count("*") > 0).alias("found")))
