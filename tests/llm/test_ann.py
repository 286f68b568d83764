import numpy as np

from semiflow.llm import ann
from semiflow.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=20, every=20):
    out = {}
    for i in sorted({i for i in ids if i % every == 0}):
        q = x[ids.index(i)]
        s = [(-sum(float(a) * float(b) for a, b in zip(q, v)), j) for j, v in zip(ids, x) if j != i]
        out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_one_part_is_exact(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8)).astype(np.float32)
    x[10:20] = x[10]
    ids = list(range(60))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    got = {}
    for row in ann.search(df).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    true = brute(ids, x.tolist())
    for q, best in true.items():
        assert [got[q][i + 1][0] for i in range(20)] == best
        assert got[q][1][1] == sum(float(a) * float(b) for a, b in zip(x[q], x[got[q][1][0]]))


def recall(spark, ids, x, **more):
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    got = {}
    for row in ann.search(df, **more).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    x, hit, asked = x.astype(float), 0, [i for i in range(len(ids)) if ids[i] % 20 == 0]
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[ids[i]] & set(np.asarray(ids)[np.argsort(-s, kind="stable")[:20]].tolist()))
    return hit / (20 * len(asked))


def test_recall_of_many_parts(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 24))
    x = (centre[r.integers(0, 12, 4000)] + 0.7 * r.normal(size=(4000, 24))).astype(np.float32)
    assert recall(spark, list(range(4000)), x, sample=2000) >= 0.9
    router = ann.train(x[:2000].astype(float), 32)
    assert router.probes <= 8  # clustered vectors are found in few parts


def test_recall_on_the_table(spark):
    """With routing: sf0.1 makes 22 parts. Its vectors have no clusters, so that a query visits most of them."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32)
    router = ann.train(x.astype(float), round(len(x) ** 0.5 / 2))
    assert router.weights.shape[1] >= 20 and router.probes < router.weights.shape[1]
    assert recall(spark, ids, x) >= 0.9


def test_large_parts_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "QUERIES", 3)
    x = np.random.default_rng(5).normal(size=(800, 6)).astype(np.float32)
    assert recall(spark, list(range(800)), x) >= 0.9


def test_parts_are_balanced():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 8))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= 55


def test_unusable_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (20, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (None, [1.0, 1.0], 0), (8, [1.0], 0), (9, [], 0)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(0, 1, 20), (0, 2, 20), (0, 3, 1), (0, 4, 7), (0, 5, 7), (20, 1, 0), (20, 2, 1), (20, 3, 7), (20, 4, 7)]
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stray_lengths_cost_no_vector(spark):
    x = np.random.default_rng(6).normal(size=(41, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 7, "p") for i, v in enumerate(x)] + [(100, [1.0] * 9, 0, 7, "p"), (120, [1.0, 2.0], 0, 7, "p"), (121, [2.0, 2.0], 0, 7, "p")]
    df = spark.createDataFrame(rows, SCHEMA + ", rank int, part string")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {0: 20, 20: 20, 40: 20, 120: 1} and got[120] == [121]
