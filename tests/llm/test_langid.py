import math
import zlib

from semiflow.llm import langid
from semiflow.llm.common import table


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "▁", "ba", "bab"]
    m = langid.Model.learn([("x", "abab", 3), ("x", "ab", 2), ("y", "ba", 4)], pieces, rounds=2)
    p = {s: m.p[i] for i, s in enumerate(pieces)}

    def total(s, k):
        return 1.0 if not s else sum(p[s[:n]][k] * total(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in p)

    find = langid.Pieces(pieces)
    for word in ("abab", "ab", "bab", "a"):
        ((_, c),) = list(langid.by_length([langid.MARK + word], 30))
        a = langid.forward(find.spans(c), *c.shape, m.p)[0, -1]
        for k in range(2):
            assert math.isclose(a[k], total(langid.MARK + word, k), rel_tol=1e-9)


def test_training_raises_the_likelihood():
    pieces = ["▁", "a", "b", "ab", "▁ab", "ba"]
    counts = [("x", "abab", 3), ("x", "baab", 2)]
    find = langid.Pieces(pieces)

    def likelihood(rounds):
        m = langid.Model.learn(counts, pieces, rounds, smooth=0.0)
        return sum(n * math.log(langid.forward(find.spans(c), *c.shape, m.p)[0, -1, 0]) for _, w, n in counts for _, c in langid.by_length([langid.MARK + w], 30))

    assert likelihood(1) <= likelihood(2) <= likelihood(5)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if got[i].held_out and true[i]]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].lang_pred == true[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    s = "doc_id long, text string, lang string, score int"
    rows = [(1, None, "en", 1), (2, "123 !?", "en", 1), (3, "", "en", 1), (8, "½ ² Ⅷ", "en", 1), (4, "the cat", "en", 1), (6, "der hund", "de", 1), (None, "der hund" * 5000, None, 1), (7, "le chien", None, 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, s)).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0) and got[None][0] in ("en", "de")
    assert langid.identify(spark.createDataFrame([], s)).collect() == []
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "words", None, 1)], s)).collect()] == ["und"]
