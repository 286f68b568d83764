"""Aggregates through joins, and what declared facts make needless."""

from pyspark.sql import functions as F

from semiflow.operators.flow import Flow
from semiflow.plans import facts, pushdown
from semiflow.queries import query
from semiflow.sources.tables import table


def qty():
    return F.col("l_quantity").cast("long")


def line(spark, d):
    return table(spark, d, "lineitem")


S = "FROM lineitem x JOIN lineitem y ON x.l_suppkey = y.l_suppkey"


def key():
    return F.col("l_suppkey")


@query(f"SELECT CAST(sum(CAST(y.l_quantity AS BIGINT)) AS BIGINT) AS value {S}")
def w8_sum_through_join(spark, d):
    return pushdown.sum_through_join(line(spark, d), line(spark, d), key(), key(), g=qty())


@query(f"SELECT CAST(count(*) AS BIGINT) AS n {S}")
def w9_count_through_join(spark, d):
    return pushdown.count_through_join(line(spark, d), line(spark, d), key(), key())


@query("SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM events JOIN orders ON user_id = o_custkey")
def w10_preaggregated(spark, d):
    return pushdown.sum_through_join(table(spark, d, "events"), table(spark, d, "orders"), F.col("user_id"), F.col("o_custkey"), g=F.round(F.col("o_totalprice") * 100).cast("long"))


@query(f"SELECT CAST(sum(CAST(x.l_quantity AS BIGINT) * y.l_linenumber) AS BIGINT) AS value {S}")
def w11_frame(spark, d):
    return pushdown.sum_through_join(line(spark, d), line(spark, d), key(), key(), qty(), F.col("l_linenumber").cast("long"))


@query(f"SELECT CAST(sum(CAST(x.l_quantity AS BIGINT) * y.l_linenumber) AS BIGINT) AS value {S} WHERE x.l_returnflag = 'A' AND y.l_quantity > 25")
def w12_guarded_frame(spark, d):
    return pushdown.sum_through_join(line(spark, d), line(spark, d), key(), key(), qty(), F.col("l_linenumber").cast("long"), F.col("l_returnflag") == "A", F.col("l_quantity") > 25)


@query(f"SELECT CAST(sum((x.l_suppkey % 7) * y.l_linenumber) AS BIGINT) AS value {S}")
def w13_key_factor(spark, d):
    return pushdown.sum_through_join(line(spark, d), line(spark, d), key(), key(), g=F.col("l_linenumber").cast("long"), of_key=lambda k: k % 7)


@query(f"SELECT x.l_returnflag, CAST(sum(CAST(y.l_quantity AS BIGINT)) AS BIGINT) AS value {S} GROUP BY 1")
def w14_group_sum_through_join(spark, d):
    return pushdown.group_sum_through_join(line(spark, d), line(spark, d), key(), key(), F.col("l_returnflag"), qty()).withColumnRenamed("group", "l_returnflag")


@query("""SELECT CAST(sum(a.n * b.n * c.q) AS BIGINT) AS value FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a
JOIN (SELECT l_suppkey AS k, sum(l_linenumber) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k JOIN (SELECT l_suppkey AS k, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) c ON a.k = c.k""")
def w16_three_way_sum(spark, d):
    side = lambda f: (line(spark, d), key(), f)
    return pushdown.sum_through_joins(side(F.lit(1).cast("long")), side(F.col("l_linenumber").cast("long")), side(qty()))


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) * 12 AS BIGINT) AS value FROM lineitem")
def w17_hoisted(spark, d):
    return pushdown.hoisted_sum(line(spark, d), qty(), 12)


@query("SELECT CAST((SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem) * (SELECT sum(o_custkey) FROM orders) AS BIGINT) AS value")
def w18_product_of_sums(spark, d):
    return pushdown.product_of_sums(line(spark, d), table(spark, d, "orders"), qty(), F.col("o_custkey"))


def known(spark, d):
    """lineitem, whose quantities are declared to be from 1 to 50."""
    return facts.Known(line(spark, d), facts.Facts((facts.Range("l_quantity", 1, 51),)))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 0")
def w19_filter_elimination(spark, d):
    return known(spark, d).filter_range("l_quantity", low=0).df.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity >= 60")
def w20_false_filter(spark, d):
    return known(spark, d).filter_range("l_quantity", low=60).df.select("l_orderkey")


@query("SELECT DISTINCT o_orderkey FROM orders")
def w21_distinct_elimination(spark, d):
    x = facts.Known(table(spark, d, "orders"), facts.Facts(unique=(("o_orderkey",),)))
    return x.project("o_orderkey").distinct().df


@query("SELECT o_orderkey, o_custkey FROM orders")
def w22_keyed_distinct_elimination(spark, d):
    x = facts.Known(table(spark, d, "orders"), facts.Facts(unique=(("o_orderkey",),)))
    return x.distinct_by("o_orderkey").df.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS n FROM orders")
def w23_self_lookup_elimination(spark, d):
    x = Flow(table(spark, d, "orders").select("o_orderkey", "o_custkey")).with_own_group("o_orderkey", unique=True).df
    return x.select("o_orderkey", F.size("group").cast("long").alias("n"))


@query("SELECT o_orderkey, o_custkey AS total FROM orders")
def f11_guarded_group(spark, d):
    x = table(spark, d, "orders")
    fast = lambda df: df.select("o_orderkey", F.col("o_custkey").alias("total"))
    return facts.guarded(x, ("o_orderkey",), fast, lambda df: df.groupBy("o_orderkey").agg(F.sum("o_custkey").alias("total")))[0]


@query("""SELECT 'c_custkey' AS "column", count(*) AS n, CAST(min(c_custkey) AS VARCHAR) AS low, CAST(max(c_custkey) AS VARCHAR) AS high, max(length(CAST(c_custkey AS VARCHAR))) AS longest, count(DISTINCT c_custkey) <= 16 AS small_domain FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), min(c_mktsegment), max(c_mktsegment), max(length(c_mktsegment)), count(DISTINCT c_mktsegment) <= 16 FROM customer""")
def f10_profile(spark, d):
    x = facts.profile(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    return x.select("column", "n", "low", "high", F.col("longest").cast("long").alias("longest"), "small_domain")


@query("SELECT round(greatest(0.01, avg(CASE WHEN l_quantity > 40 THEN 1.0::DOUBLE ELSE 0 END)), 9) AS selectivity FROM lineitem")
def f10_selectivity(spark, d):
    """Measured on every row: a fraction under 1 estimates."""
    s = facts.selectivity(line(spark, d), F.col("l_quantity") > 40, fraction=1.0)
    return spark.createDataFrame([(round(s, 9),)], "selectivity double")


@query("""SELECT * FROM (VALUES (0, 'filter l_quantity: dropped, always true (declared)'), (1, 'filter l_partkey: kept'), (2, 'project'), (3, 'distinct: kept')) t(i, note)""")
def f8_report(spark, d):
    """What was decided for each step of a plan."""
    x = known(spark, d).filter_range("l_quantity", low=0).filter_range("l_partkey", high=100).project("l_partkey").distinct()
    return spark.createDataFrame(list(enumerate(x.notes)), "i int, note string")


@query("""SELECT * FROM (VALUES ('none', 0), ('range', 1), ('range and key', 2)) t(tier, dropped)""")
def f9_unlocked(spark, d):
    """How many steps each set of declared facts lets drop."""
    steps = lambda k: k.filter_range("o_custkey", low=1).distinct_by("o_orderkey")
    low = facts.Range("o_custkey", 1, None)
    tiers = {"none": facts.Facts(), "range": facts.Facts((low,)), "range and key": facts.Facts((low,), (("o_orderkey",),))}
    return spark.createDataFrame([(k, len(v)) for k, v in facts.unlocked(table(spark, d, "orders"), steps, tiers).items()], "tier string, dropped int")
