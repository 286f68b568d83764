import math

import numpy as np

from semiflow.llm import toxicity
from semiflow.llm.common import table


def kernel(a, b):
    def vector(u):
        s, out = toxicity.symbols(np.array([[ord(c) for c in u]]))[0], {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH)):
                    key = (s[i], s[j], s[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = vector(a), vector(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_features_give_the_kernel():
    words = ["stupid", "stuupid", "tuspid", "lovely", "banana"]
    small = np.full(toxicity.SIZE, -1)
    codes = np.unique(np.concatenate([np.unique(toxicity.subsequences(c)[0]) for _, c in toxicity.by_length(words, 30)]))
    small[codes] = np.arange(len(codes))
    f = toxicity.features(words, small)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert math.isclose(f[i] @ f[j], kernel(a, b), abs_tol=1e-5)


def sample():
    clean = ["the cat sat on the mat", "a fine day for a walk", "stupor is a word", "we read an idle riot of words", "trust the moor on"] * 6
    bad = ["you are a stupid cat", "what an idiot he is", "that moron sat here", "a stupid idiot", "the moron and the idiot walk"] * 6
    return clean + bad, [0] * len(clean) + [1] * len(bad)


def test_scores_tolerate_gaps_and_insertions():
    m = toxicity.fit(*sample())
    of = m.scorer()
    bad = of(["you i-d-i-o-t", "s.t.u.p.i.d thing", "such a stuupid one", "i d i o t", "St*pid? no, STUPID!"])
    good = of(["the cat sat", "a fine riot of words", "", None, "...", "trust the stupor"])
    assert (bad >= 0.5).all() and (good < 0.5).all()


def test_near_units_are_all_those_over_the_floor():
    marks = toxicity.Landmarks(["stupid", "idiot", "moron"])
    units = ["stupid", "stuupid", "stupd", "idiotic", "cat", "walk", "moro", "dotidi", "ab"]
    at, rows = marks.near(units)
    got = dict(zip(at.tolist(), rows))
    for i, u in enumerate(units):
        k = [kernel(u, m) for m in marks.units]
        assert (i in got) == (max(k) >= toxicity.FLOOR)
        if i in got:
            assert np.allclose(got[i], [max(0, (x - toxicity.FLOOR) / (1 - toxicity.FLOOR)) for x in k], atol=1e-5)


def test_one_insult_in_a_long_text_tells():
    m = toxicity.fit(*sample())
    rest = "the cat sat on the mat and we read of a fine riot " * 2000
    assert m.scorer()([rest])[0] < 0.5 <= m.scorer()([rest + "stupid"])[0]


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.rate(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    held = [i for i in labels if got[i].held_out]
    clean = [i for i in held if labels[i] == 0]
    assert sum(got[i].predicted == 0 for i in clean) >= 0.97 * len(clean)
    bad = [i for i in held if labels[i] == 1]
    assert sum(got[i].predicted for i in bad) >= 0.8 * len(bad)  # 45 toxic texts teach, and 6 are held out


def test_held_out_documents_of_the_large_table(spark):
    d = "/root/testdata/check_s"
    labels = table(spark, d, "labels").filter("toxic is not null")
    docs = table(spark, d, "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    got = {r.doc_id: r for r in toxicity.rate(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    bad, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert len(bad) > 300 and sum(bad) >= 0.97 * len(bad) and sum(clean) <= 0.003 * len(clean)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "x" * 50_000, 2.0), (3, "1 2 3", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.rate(docs, none).collect()] == [(0.0, 0)] * 4
    one = spark.createDataFrame([(1, 1, None), (2, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.rate(docs, one).count() == 4 and toxicity.rate(docs.limit(0), one).collect() == []
