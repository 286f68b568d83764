"""Weighted sets, views kept by deltas, fixpoints, streams."""

from pyspark.sql import functions as F

from semiflow.operators.flow import Flow
from semiflow.queries import query
from semiflow.sources.tables import table
from semiflow.streaming import fixpoint, incremental, structured, zset

#: Every event, and every event taken off twice.
A = "SELECT user_id, event_type, count(*) AS w FROM events GROUP BY 1, 2"
B = "SELECT user_id, event_type, -2 * count(*) AS w FROM events GROUP BY 1, 2"


def events(spark, d):
    return table(spark, d, "events").select("user_id", "event_type")


def a(spark, d):
    return zset.consolidate(zset.zset(events(spark, d)))


def b(spark, d):
    return zset.consolidate(zset.zset(events(spark, d), -2))


def shown(z):
    return z.withColumnRenamed("_w", "w")


@query(f"SELECT user_id, event_type, CAST(sum(w) AS BIGINT) AS w FROM ({A} UNION ALL {B}) GROUP BY 1, 2 HAVING sum(w) <> 0")
def i1_add(spark, d):
    return shown(zset.add(a(spark, d), b(spark, d)))


@query(f"SELECT user_id, event_type, CAST(-w AS BIGINT) AS w FROM ({A})")
def i2_negate(spark, d):
    return shown(zset.negate(a(spark, d)))


@query(f"SELECT * FROM ({A}) WHERE event_type = 'click'")
def i3_filter(spark, d):
    return shown(zset.where(a(spark, d), F.col("event_type") == "click"))


@query(f"SELECT user_id % 10 AS k, CAST(sum(w) AS BIGINT) AS w FROM ({A}) GROUP BY 1")
def i4_map(spark, d):
    return shown(zset.project(a(spark, d), (F.col("user_id") % 10).alias("k")))


@query(f"SELECT CAST(sum(w * user_id) AS BIGINT) AS value FROM ({A})")
def i5_sum(spark, d):
    return zset.total(a(spark, d), F.col("user_id"))


@query(f"SELECT x.user_id AS l_user_id, x.event_type AS l_event_type, y.user_id AS r_user_id, y.event_type AS r_event_type, x.w * y.w AS w FROM ({A}) x JOIN ({B}) y ON x.user_id = y.user_id")
def i6_join(spark, d):
    return shown(zset.join(a(spark, d), b(spark, d), F.col("user_id"), F.col("user_id")))


@query(f"SELECT CAST((SELECT sum(w) FROM ({A})) * (SELECT sum(w) FROM ({B})) AS BIGINT) AS value")
def j12_weighted_product(spark, d):
    x = zset.project(a(spark, d), F.lit(1).alias("one"))
    return zset.cardinality(zset.product(x, zset.project(b(spark, d), F.lit(1).alias("one"))))


def cents():
    return F.round(F.col("r_o_totalprice") * 100).cast("long")


def parts(spark, d):
    """Deltas that together are all customers and orders: some orders come twice at first, and once go again."""
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    z = zset.zset
    return [
        (z(c.filter("c_custkey % 2 = 0")), z(o.filter("o_orderkey % 3 = 0"))),
        (z(c.filter("c_custkey % 2 <> 0")), zset.add(z(o.filter("o_orderkey % 3 = 1")), z(o.filter("o_orderkey % 5 = 0")))),
        (z(c.limit(0)), z(o.filter("o_orderkey % 3 NOT IN (0, 1)"))),
        (z(c.limit(0)), z(o.filter("o_orderkey % 5 = 0"), -1)),
    ]


def sided(spark, d):
    """The same deltas as a stream of both sides, and what feeds it."""
    return structured.fed([structured.both_sides(l, r) for l, r in parts(spark, d)])


#: Recursive SQL gives the closure of all links.
REACH = """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r"""
LEFT, RIGHT = ["c_custkey", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_totalprice"]
#: The join after each of the deltas, with the weight that each of its rows then has.
STEPS = """SELECT s.range AS step, c_mktsegment, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE WHEN c_custkey % 2 = 0 OR s.range >= 1 THEN 1 ELSE 0 END * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s.range >= 1 AND o_orderkey % 3 = 1 THEN 1 ELSE 0 END
  + CASE WHEN s.range IN (1, 2) AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN s.range >= 2 AND o_orderkey % 3 NOT IN (0, 1) THEN 1 ELSE 0 END) AS w
FROM customer JOIN orders ON c_custkey = o_custkey CROSS JOIN range(4) s"""
REVENUE = "CAST(coalesce(sum(cents * w) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS BIGINT)"


def keys():
    return F.col("c_custkey"), F.col("o_custkey")


def building():
    return [("filter", F.col("l_c_mktsegment") == "BUILDING"), ("sum", cents())]


@query(f"SELECT step, {REVENUE} AS value FROM ({STEPS}) GROUP BY step")
def i8_incremental_views(spark, d):
    """The revenue after each delta."""
    return incremental.Query(building(), keys()).running(parts(spark, d))


FINAL = "SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"


@query(FINAL)
def i8_incremental_final_view(spark, d):
    """The revenue after the last delta: what all deltas' changes add up to."""
    changes = incremental.Query(building(), keys()).changes(parts(spark, d))
    return changes.agg(F.sum("value").alias("value"))


@query(FINAL)
def i9_incremental_batch(spark, d):
    x = parts(spark, d)
    l, r = x[0][0], x[0][1]
    for p in x[1:]:
        l, r = zset.add(l, p[0]), zset.add(r, p[1])
    return incremental.Query(building(), keys()).batch(l, r)


def quarters(spark, d):
    """All events, as four deltas; those of the last are taken off."""
    e = table(spark, d, "events")
    return [zset.zset(e.filter(f"event_id % 4 = {i}").select("user_id"), -1 if i == 3 else 1) for i in range(4)]


@query("SELECT (event_id % 4) // 2 AS step, user_id, CAST(sum(CASE WHEN event_id % 4 = 3 THEN -1 ELSE 1 END) AS BIGINT) AS w FROM events GROUP BY 1, 2 HAVING sum(CASE WHEN event_id % 4 = 3 THEN -1 ELSE 1 END) <> 0")
def i14_resampled(spark, d):
    """A stream's changes on a clock of half its pace."""
    stream, feed = structured.fed(quarters(spark, d))
    return shown(incremental.every_nth(2, structured.changes(incremental.Query([]), stream, feed=feed)))


@query(f"SELECT 'revenue' AS branch, step, {REVENUE} AS value FROM ({STEPS}) GROUP BY step UNION ALL SELECT 'links', step, CAST(sum(w) AS BIGINT) FROM ({STEPS}) GROUP BY step")
def i15_live_graph(spark, d):
    """The join of two streams feeds two running sums."""
    stream, feed = sided(spark, d)
    return structured.fan_out(stream, {"revenue": building(), "links": [("count",)]}, keys(), LEFT, RIGHT, feed)


@query("SELECT event_id % 4 AS step, CAST(max(count(*)) OVER (ORDER BY event_id % 4) AS BIGINT) AS value FROM events GROUP BY event_id % 4")
def i17_per_batch(spark, d):
    """The largest micro-batch so far, after each."""
    e = table(spark, d, "events")
    stream, feed = structured.fed([zset.zset(e.filter(f"event_id % 4 = {i}").select("user_id")) for i in range(4)])
    return incremental.per_batch(structured.changes(incremental.Query([("count",)]), stream, feed=feed), F.max)


@query(REACH)
def i19_reachability(spark, d):
    """Pairs that paths over all customer-order links join."""
    return fixpoint.reachable(table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).distinct())


def series(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("t"), F.col("user_id").alias("value"))


@query("SELECT event_id AS t, user_id - coalesce(lag(user_id) OVER (ORDER BY event_id), 0) AS value FROM events")
def i20_difference(spark, d):
    return incremental.difference(series(spark, d))


@query("SELECT event_id AS t, CAST(sum(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM events")
def i20_integral(spark, d):
    return incremental.integral(series(spark, d))


@query("SELECT event_id AS t, user_id AS value FROM events")
def i20_integral_of_difference(spark, d):
    return incremental.integral(incremental.difference(series(spark, d)))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def i11_structured_counts(spark, d):
    """The table as a stream: each micro-batch's change is added to a written view."""
    e = table(spark, d, "events")
    stream, feed = structured.fed([zset.zset(e.filter(f"event_id % 3 = {i}").select("event_type")) for i in range(3)])
    x = structured.changes(incremental.Query([("map", [F.col("event_type")])]), stream, feed=feed)
    return zset.consolidate(x.drop("step")).select("event_type", F.col("_w").alias("n"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS w FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def i11_structured_join(spark, d):
    """The view of a join of two streams, which the changes of all micro-batches add up to."""
    stream, feed = sided(spark, d)
    q = incremental.Query([("map", [F.col("l_c_mktsegment").alias("c_mktsegment")])], keys())
    return shown(zset.consolidate(structured.changes(q, stream, LEFT, RIGHT, feed).drop("step")))


@query("SELECT CAST(sum(user_id * 3 + 1) AS BIGINT) AS value FROM events")
def f5_foreign_leaf(spark, d):
    """A function from outside in a view kept by deltas; its notes call it trusted."""
    import pandas as pd

    @F.pandas_udf("long")
    def outside(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    e = table(spark, d, "events")
    q = incremental.Query([("foreign", "times three", [outside(F.col("user_id")).alias("v")]), ("sum", F.col("v"))])
    return zset.total(q.changes([(zset.zset(e.filter(f"event_id % 2 = {i}").select("user_id")),) for i in range(2)]).withColumn("_w", F.lit(1)), F.col("value"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def i25_event_time_windows(spark, d):
    """Windows of a stream with a watermark, fed in two parts by time."""
    e = table(spark, d, "events").select("ts", "event_type")
    first = F.col("ts") < e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).first()[0]
    stream, feed = structured.fed([e.filter(first), e.filter(~first | F.col("ts").isNull())])
    w = structured.windowed(stream, "ts", "1 hour", "10 minutes", {"n": F.count("*")}, ("event_type",))
    return structured.latest(w, ["event_type", "start"], feed).select("event_type", "start", "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def i25_sessions(spark, d):
    return structured.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id").select("user_id", "start", "n")


@query(f"SELECT x.user_id AS l_user_id, x.event_type AS l_event_type, y.user_id AS r_user_id, y.event_type AS r_event_type, x.w * y.w AS w FROM ({A}) x JOIN ({B}) y ON x.user_id = y.user_id")
def i7_join_step(spark, d):
    """The change of an empty join when both inputs arrive at once, in two steps that must add up."""
    k = F.col("user_id")
    x, y = a(spark, d), b(spark, d)
    view = incremental.JoinView((k, k))
    first = view.step(x.filter("user_id % 2 = 0"), y)
    return shown(zset.add(first, view.step(x.filter("user_id % 2 <> 0 OR user_id IS NULL"), y.limit(0))))


@query(f"SELECT CAST(sum(w) AS BIGINT) AS value FROM ({A} UNION ALL {B})")
def i18_net_cardinality(spark, d):
    return zset.cardinality(a(spark, d).unionByName(b(spark, d)))


@query("SELECT CAST(range AS BIGINT) AS t, CAST(range * range AS BIGINT) AS squares FROM range(200)")
def i21_window_of_an_endless_stream(spark, d):
    x = structured.take(structured.endless(spark), 200)
    return x.select(F.col("value").alias("t"), (F.col("value") * F.col("value")).alias("squares"))


@query("SELECT CAST(range AS BIGINT) AS pos, CAST((range * (range - 1)) // 2 AS BIGINT) AS value FROM range(201)")
def i21_scan_of_an_endless_stream(spark, d):
    x = structured.take(structured.endless(spark), 200)
    return Flow(x.select("value"), ("value",)).reductions(F.col("value"), 0).df.select(F.col("_pos").alias("pos"), "value")


@query(f"SELECT step, CAST(sum(w) AS BIGINT) AS value FROM ({STEPS}) GROUP BY step")
def i23_running_join_count(spark, d):
    """Links between two streams, after each micro-batch."""
    stream, feed = sided(spark, d)
    return incremental.running(structured.changes(incremental.Query([("count",)], keys()), stream, LEFT, RIGHT, feed))
