"""Step-by-step equality of views kept by deltas with recomputation, and fixpoints."""

import pytest
from pyspark.sql import functions as F

from semiflow.inference import lens
from semiflow.scratch import scratch
from semiflow.streaming import fixpoint, incremental, structured, zset

C, O = "id long, tier string, _w long", "cid long, amt long, _w long"


@pytest.fixture(scope="module")
def deltas(spark):
    steps = [([(1, "gold", 1)], []), ([], [(1, 100, 1)]), ([(2, "base", 1)], [(2, 50, 1)]), ([], [(1, 30, 1)]), ([], [(1, 100, -1)])]
    return [(spark.createDataFrame(c, C), spark.createDataFrame(o, O)) for c, o in steps]


def query(stages):
    return incremental.Query(stages, (F.col("id"), F.col("cid")))


def values(df, *by):
    return [r.value for r in df.orderBy(*by, "step").collect()]


def test_running_revenue_and_count(deltas):
    gold = ("filter", F.col("l_tier") == "gold")
    assert values(query([gold, ("sum", F.col("r_amt"))]).running(deltas)) == [0, 100, 100, 130, 30]
    assert values(query([("count",)]).running(deltas)) == [0, 1, 2, 3, 2]
    with pytest.raises(incremental.NotIncremental):
        query([gold]).running(deltas)


def test_state_is_consolidated_now_and_then(deltas, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 1)
    monkeypatch.setattr(structured, "COMPACT", 2)
    assert values(query([("count",)]).running(deltas)) == [0, 1, 2, 3, 2]
    stream, feed = structured.fed([structured.both_sides(l, r) for l, r in deltas])
    assert values(incremental.running(structured.changes(query([("count",)]), stream, ["id", "tier"], ["cid", "amt"], feed))) == [0, 1, 2, 3, 2]


def test_each_step_equals_recomputation(deltas):
    q = query([("map", [F.col("l_tier").alias("tier"), F.col("r_amt").alias("amt")])])
    l = r = None
    for view, (dl, dr) in zip(q.run(deltas), deltas):
        l, r = (dl, dr) if l is None else (zset.add(l, dl), zset.add(r, dr))
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, zset.consolidate(q.batch(l, r)).collect()))


def test_streams_fan_out(deltas):
    gold = ("filter", F.col("l_tier") == "gold")
    stream, feed = structured.fed([structured.both_sides(l, r) for l, r in deltas])
    branches = {"a revenue": [gold, ("sum", F.col("r_amt"))], "b count": [("count",)]}
    got = structured.fan_out(stream, branches, (F.col("id"), F.col("cid")), ["id", "tier"], ["cid", "amt"], feed)
    assert values(got, "branch") == [0, 100, 100, 130, 30, 0, 1, 2, 3, 2]


def test_a_join_needs_both_sides(spark, deltas):
    stream, _ = structured.fed([deltas[0][0]])
    with pytest.raises(incremental.NotIncremental):
        structured.changes(query([("count",)]), stream)
    with pytest.raises(incremental.NotIncremental):
        structured.fan_out(stream, {"a": [("map", [F.col("id")])]})
    with pytest.raises(incremental.NotIncremental):
        structured.fan_out(deltas[0][0], {"a": [("count",)]})


def test_foreign_stages_are_trusted(spark):
    twice = F.pandas_udf(lambda x: 2 * x, "long")
    q = incremental.Query([("foreign", "twice", [twice(F.col("x")).alias("y")]), ("sum", F.col("y"))])
    assert q.notes == ["foreign twice: linear (trusted)", "sum: linear"]
    assert values(q.running([(spark.createDataFrame([(i, 1)], "x long, _w long"),) for i in (3, 4)])) == [6, 14]


def test_windows_drop_what_is_late(spark):
    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    part = lambda *ts: spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    stream, feed = structured.fed([part(at(0), at(0, 30), at(5)), part(at(5, 10)), part(at(0, 45), at(6))])
    w = structured.windowed(stream, "ts", "1 hour", "10 minutes", {"n": F.count("*")})
    assert {r.start.hour: r.n for r in structured.latest(w, ["start"], feed).collect()} == {0: 2, 5: 2, 6: 1}
    assert {r.start.hour: r.n for r in structured.windowed(part(at(0), at(0, 45)), "ts", "1 hour", "10 minutes", {"n": F.count("*")}).collect()} == {0: 2}


def test_refuses_what_deltas_cannot_keep(spark):
    with pytest.raises(incremental.NotIncremental):
        incremental.Query([("distinct",)])
    with pytest.raises(incremental.NotIncremental):
        incremental.Query([("sum", F.lit(1)), ("map", [])])
    assert incremental.rebuild(10, 2, 100) == "incremental" and incremental.rebuild(60, 2, 100) == "batch"
    stream = spark.readStream.format("rate").load()
    assert incremental.mode(stream, spark.range(1)) == "stream"
    with pytest.raises(incremental.NotIncremental):
        incremental.bounded(stream, "reduce")


def test_slower_clock(spark):
    z = spark.createDataFrame([(i, "x", 1) for i in range(5)] + [(1, "y", 1), (0, "y", -1)], "step long, x string, _w long")
    assert sorted(map(tuple, incremental.every_nth(2, z).collect())) == [(0, "x", 2), (1, "x", 2), (2, "x", 1)]
    own = spark.createDataFrame([(0, 3), (1, 1), (2, 5)], "step long, value long")
    assert values(incremental.per_batch(own, F.max)) == [3, 3, 5] and values(incremental.per_batch(own, F.sum)) == [3, 4, 9]


def test_a_window_of_an_endless_stream(spark):
    x = structured.take(structured.endless(spark, 7), 20)
    assert sorted(r.value for r in x.collect()) == list(range(20))


def test_fixpoints_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "a long, b long")
    hop = e.toDF("b", "c")
    step = lambda x: x.join(hop, "b").select("a", F.col("c").alias("b"))
    want = {(1, 2), (1, 3), (1, 4), *((a, b) for a in (2, 3, 4) for b in (2, 3, 4))}
    assert {tuple(r) for r in fixpoint.reachable(e).collect()} == want == {tuple(r) for r in fixpoint.naive(e, step).collect()}
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.seminaive(spark.createDataFrame([(0,)], "a long"), lambda x: x.select((F.col("a") + 1).alias("a")), max_rounds=3)


def test_structured_streaming_replays(spark):
    src = scratch(spark, "in")
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 1)], [("b", -1)]]):
        spark.createDataFrame(rows, "k string, _w long").coalesce(1).write.mode("append").parquet(src)
    seen = {}
    structured.run(incremental.Query([("count",)]), structured.deltas(spark, src, "k string, _w long", 1), scratch(spark, "state"), lambda df, n: seen.__setitem__(n, df.first()[0]))
    assert sum(seen.values()) == 2 and len(seen) >= 3
    chosen = structured.chosen_per_batch(structured.deltas(spark, src, "k string, _w long", 1), scratch(spark, "state"), lambda df: df.count() > 1, lambda df: df, lambda df: df, lambda df, n: df.count(), cutoff=2)
    assert set(chosen) <= {"fast", "slow"}


def test_stream_calculus(spark):
    s = spark.createDataFrame(list(enumerate([3, 1, 4, 1, 5])), "t long, value long")
    assert [r.value for r in incremental.difference(s).orderBy("t").collect()] == [3, -2, 3, -3, 4]
    assert [r.value for r in incremental.integral(s).orderBy("t").collect()] == [3, 4, 8, 9, 14]


def test_delta_lens_guards_the_view(spark):
    z = spark.createDataFrame([(1, 5, 1), (2, 50, 1)], "id long, v long, _w long")
    ok = lens.filtered_edit(z, F.col("v") > 10, spark.createDataFrame([(2, 50, -1), (2, 60, 1)], z.schema))
    assert sorted(map(tuple, ok.collect())) == [(1, 5, 1), (2, 60, 1)]
    with pytest.raises(Exception, match="outside the view"):
        lens.filtered_edit(z, F.col("v") > 10, spark.createDataFrame([(3, 1, 1)], z.schema)).collect()
