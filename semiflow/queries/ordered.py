"""Verbs that depend on the order of rows."""

from pyspark.sql import functions as F

from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources.tables import table


def events(spark, d):
    return Flow(table(spark, d, "events"), ("event_id",))


def orders(spark, d):
    return Flow(table(spark, d, "orders"), ("o_orderkey",))


NUMBERED = "SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events"


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25")
def o1_take(spark, d):
    return events(spark, d).take(25).rows().select("event_id", "user_id")


@query(f"SELECT event_id FROM ({NUMBERED}) WHERE pos >= 100")
def o2_drop(spark, d):
    return events(spark, d).drop(100).rows().select("event_id")


@query(f"WITH p AS ({NUMBERED}) SELECT event_id FROM p WHERE pos < (SELECT coalesce(min(pos), 9223372036854775807) FROM p WHERE NOT (value < 90))")
def o3_take_while(spark, d):
    return events(spark, d).take_while(F.col("value") < 90).rows().select("event_id")


@query(f"WITH p AS ({NUMBERED}) SELECT event_id FROM p WHERE pos >= (SELECT min(pos) FROM p WHERE NOT (value < 90))")
def o4_drop_while(spark, d):
    return events(spark, d).drop_while(F.col("value") < 90).rows().select("event_id")


@query("SELECT event_id FROM events WHERE event_id < (SELECT max(event_id) FROM events)")
def o5_drop_last(spark, d):
    return events(spark, d).drop_last().rows().select("event_id")


@query(f"SELECT event_id FROM ({NUMBERED}) WHERE pos % 7 = 0")
def o6_take_nth(spark, d):
    return events(spark, d).take_nth(7).rows().select("event_id")


@query(f"SELECT user_id AS value FROM ({NUMBERED}) WHERE pos = 42")
def o7_nth(spark, d):
    return events(spark, d).nth(42, "user_id", -1)


@query("SELECT -1 AS value")
def o7_nth_default(spark, d):
    return events(spark, d).nth(10**12, "user_id", -1).select(F.col("value").cast("int").alias("value"))


@query("SELECT min_by(user_id, event_id) AS first, (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r = 2) AS second, max_by(user_id, event_id) AS last FROM events")
def o8_first_second_last(spark, d):
    x = events(spark, d)
    one, two, end = x.first("user_id"), x.second("user_id"), x.last("user_id")
    return one.select(F.col("value").alias("first")).crossJoin(two.select(F.col("value").alias("second"))).crossJoin(end.select(F.col("value").alias("last")))


@query(f"SELECT event_id FROM ({NUMBERED}) WHERE pos >= 1")
def o9_rest(spark, d):
    return events(spark, d).rest().rows().select("event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos FROM events")
def o10_reverse(spark, d):
    return events(spark, d).reverse().df.select("event_id", F.col("_pos").alias("pos"))


@query("SELECT row_number() OVER (ORDER BY s, k) - 1 AS pos, k FROM (SELECT 0 AS s, o_orderkey AS k FROM orders UNION ALL SELECT 1, event_id FROM events)")
def o11_concat(spark, d):
    a = Flow(orders(spark, d).df.select(F.col("o_orderkey").alias("k")), ("k",))
    b = Flow(events(spark, d).df.select(F.col("event_id").alias("k")), ("k",))
    return a.concat(b).indexed().df.select(F.col("_pos").alias("pos"), "k")


@query("SELECT * FROM (SELECT 2 * (row_number() OVER (ORDER BY event_id) - 1) AS pos, user_id FROM events UNION ALL SELECT 2 * (row_number() OVER (ORDER BY event_id) - 1) - 1, -1 FROM events) WHERE pos >= 0")
def o12_interpose(spark, d):
    return events(spark, d).interpose(F.lit(-1).cast("long"), "user_id").df.select(F.col("_pos").alias("pos"), "user_id")


@query("SELECT l, r, a.pos FROM (SELECT o_custkey AS l, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) a JOIN (SELECT user_id AS r, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) b ON a.pos = b.pos")
def o13_zip(spark, d):
    return orders(spark, d).zip(events(spark, d), "o_custkey", "user_id").df.select("l", "r", F.col("_pos").alias("pos"))


@query("""WITH z AS (SELECT l, r, a.pos FROM (SELECT o_custkey AS l, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) a JOIN (SELECT user_id AS r, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) b ON a.pos = b.pos)
SELECT 2 * pos AS pos, l AS value FROM z UNION ALL SELECT 2 * pos + 1, r FROM z""")
def o14_interleave(spark, d):
    return orders(spark, d).interleave(events(spark, d), "o_custkey", "user_id").df.select(F.col("_pos").alias("pos"), "value")


@query(f"SELECT pos // 64 AS chunk_no, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, min_by(user_id, pos) AS head FROM ({NUMBERED}) GROUP BY 1")
def o15_partition_all(spark, d):
    c = F.col("chunk")
    x = events(spark, d).partition_all(64, "user_id").df
    return x.select(F.col("_pos").alias("chunk_no"), F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), c[0].alias("head"))


@query(f"SELECT pos // 64 AS chunk_no, CAST(sum(user_id) AS BIGINT) AS total FROM ({NUMBERED}) GROUP BY 1 HAVING count(*) = 64")
def o16_partition(spark, d):
    x = events(spark, d).partition(64, "user_id").df
    return x.select(F.col("_pos").alias("chunk_no"), F.aggregate("chunk", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS pos, CAST(10 + sum(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM events UNION ALL SELECT 0, 10")
def o17_reductions(spark, d):
    return events(spark, d).reductions(F.col("user_id"), 10).df.select(F.col("_pos").alias("pos"), "value")


@query("SELECT row_number() OVER (ORDER BY event_id) AS pos, greatest(0, max(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS value FROM events UNION ALL SELECT 0, 0")
def o17_running_max(spark, d):
    x = events(spark, d).reductions(F.col("user_id"), 0, F.max, lambda a, b: F.greatest(a, b))
    return x.df.select(F.col("_pos").alias("pos"), "value")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS prev, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r = 1 OR event_type IS DISTINCT FROM prev")
def o18_dedupe(spark, d):
    return events(spark, d).dedupe("event_type").rows().select("event_id", "event_type")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders")
def o19_sort(spark, d):
    return orders(spark, d).sort("o_custkey").indexed().df.select("o_orderkey", F.col("_pos").alias("pos"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS pos FROM customer")
def o20_sort_by(spark, d):
    return Flow(table(spark, d, "customer"), ("c_custkey",)).sort("c_mktsegment").indexed().df.select("c_custkey", F.col("_pos").alias("pos"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def o21_top(spark, d):
    return orders(spark, d).top(10, "o_totalprice").rows().select("o_orderkey", "o_totalprice")
