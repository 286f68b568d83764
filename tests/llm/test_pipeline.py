import pytest
from pyspark.sql import functions as F

from semiflow.llm import decontaminate, neardup, pii
from semiflow.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, d)
        assert new.columns == table(spark, d, "documents").columns
        new = corpus_pipeline.cut(new, name)
        sizes.append((docs.count(), new.count()))
        docs = new
    assert all(a >= b for a, b in sizes) and sizes[1][0] > sizes[1][1] and sizes[3][0] == sizes[3][1]
    ids = [r.doc_id for r in docs.collect()]
    found = neardup.classes(docs.select("doc_id", "text"))
    assert found.filter("class_id <> doc_id").count() <= 2  # marks in place of data may make texts alike
    assert decontaminate.matches(docs, table(spark, d, "benchmark")).count() == 0
    assert pii.find(docs).agg(F.sum("n_email")).first()[0] == 0
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} <= set(ids) and all(r.copies in (1, 2) for r in out)


def tables(spark, at, docs, labels, items):
    more = "copies int, mix_copies int, __h int, _lot int, score double, rank int, bin int"
    spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, 6, 7) for r in docs], f"doc_id long, text string, lang string, source string, n_chars long, {more}").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_edges_go_through_all_stages(spark, tmp_path):
    plain = lambda i: f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30))
    bad = [(i, f"you stupid moron of kind {i}, idiot, what a stupid moron and idiot", None, "s", 0) for i in range(10)]
    docs = [(100 + i, plain(i), "en", ("s", "t", None)[i % 3], 0) for i in range(30)] + bad
    docs += [(200, plain(3), "en", "s", 0), (201, None, None, None, None), (202, "", None, "s", 0), (None, plain(5), "en", "s", 0), (None, None, None, None, None)]
    docs += [(203, "mail a@b.com now " * 3, "en", "t", 0), (203, "mail a@b.com now " * 3, "en", "t", 0), (204, f"{plain(90)} the quick brown fox jumps over the lazy dog again", "en", "s", 0), (205, "ab " * 300_000, "en", "s", 0)]
    labels = [(i, 1, 1) for i in range(10)] + [(100 + i, 1, 0) for i in range(30)] + [(None, None, None)]
    d = tables(spark, tmp_path / "some", docs, labels, [(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (3, "")])
    out = corpus_pipeline.run(spark, d)
    got = [(r.doc_id, r.text) for r in out.collect()]
    ids = [i for i, _ in got if i is not None]
    assert len(ids) == len(set(ids)) and not set(ids) & {*range(10), 200, 204}
    assert all(t is None or "a@b.com" not in t for _, t in got)
    assert {(r.copies_in, r.mix_copies, r["__h"], r._lot, r.score, r["rank"], r.bin) for r in out.collect()} == {(1, 2, 3, 4, 0.5, 6, 7)}
    names = table(spark, d, "documents").columns
    step = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.cut(stage(spark, step, d))
        assert step.columns == names
    kept = {r.doc_id for r in step.collect()}
    assert kept == {i for i, *_ in docs} - {*range(10), 200, 204}


def test_nothing_in_nothing_out(spark, tmp_path):
    d = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, d).collect() == []
