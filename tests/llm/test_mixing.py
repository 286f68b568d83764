import random
import re

from semiflow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = budget - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def rows(n=400, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["a"] * 5 + ["b", "c", None]), 0) for i in range(n)] + [(900, None, "en", "a", 0), (901, "x\u00a0y z", None, "ä", 0), (1, "again", "en", "a", 0)]


def test_report_matches_brute_force(spark):
    data = rows()
    got = mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()
    size = {}
    for _, t, _, s, _ in data:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(size)
    assert len(got) == len(data)
    for g in got:
        assert g.taken == g.copies * g["size"] <= 2 * g["size"]
    by = {}
    for g in got:
        k = (g.source_size, round(g.target, 6))
        by[k] = by.get(k, 0) + g.taken
    for s, n in size.items():
        k = (n, round(target[s], 6))
        assert k in by
        assert abs(by[k] - target[s]) <= 120
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()), key=str)


def test_empty_null_and_clashing_columns(spark):
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).collect() == []
    only = mixing.mix_report(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
    x = spark.createDataFrame([(i, "a b c", "s", 9, 9, 9) for i in range(20)], "doc_id long, text string, source string, copies int, h int, target int")
    out = mixing.mixed_documents(x)
    assert set(out.columns) == {"doc_id", "text", "source", "h", "target", "copies", "copies_in"}
    assert out.agg({"copies": "sum", "copies_in": "max"}).first()["sum(copies)"] == 30


def test_names_of_helper_columns_are_free(spark):
    x = spark.createDataFrame([(i, "a b c", "s", -5, -6, -7, -8) for i in range(20)], "doc_id long, text string, source string, __h int, __n int, mix_copies int, _copies int")
    out = mixing.mixed_documents(x).collect()
    assert sum(r.copies for r in out) == 30 and {(r["__h"], r["__n"], r.mix_copies, r._copies) for r in out} == {(-5, -6, -7, -8)}


def test_rows_without_ids_meet_their_target(spark):
    data = [(None, f"word{i} a b c", None, "s" if i % 4 else "t", 0) for i in range(400)]
    got = mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()
    for n in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == n]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8


def test_a_very_long_text(spark):
    got = {r.doc_id: r for r in mixing.mix_report(spark.createDataFrame([(1, "ab " * 400_000, "en", "a", 0), (2, "x", "en", "a", 0)], SCHEMA)).collect()}
    assert got[1]["size"] == 400_000 and got[1].taken <= 800_000
