from pyspark.sql import functions as F

from semiflow.llm.common import among, cut, maybe_among, not_among


def test_ids_are_found_exactly(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("_lot"), F.lit("x").alias("bit"))
    rows = rows.union(spark.createDataFrame([(None, 1, "null")], "doc_id long, _lot long, bit string"))
    ids = cut(spark.range(0, 20_000, 3).select((F.col("id") - 600).alias("doc_id")), "ids")
    want = {i for i in range(5000) if i % 3 == 0}
    got = among(rows, ids, "doc_id")
    assert got.columns == rows.columns and {r.doc_id for r in got.collect()} == want
    rest = not_among(rows, ids, "doc_id")
    assert rest.columns == rows.columns and rest.count() == 5001 - len(want)
    assert {r.doc_id for r in rest.collect()} == {i for i in range(5000) if i % 3} | {None}
    marked, maybe = maybe_among(rows, ids, "doc_id")
    assert marked.filter(F.col(maybe)).count() < 1.1 * len(want)


def test_no_ids(spark):
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    none = cut(rows.limit(0), "ids")
    assert among(rows, none, "doc_id").isEmpty() and not_among(rows, none, "doc_id").count() == 10
    assert not_among(rows.limit(0), none, "doc_id").isEmpty()
