import random

from hypothesis import given, settings
from hypothesis import strategies as st

from semiflow.llm import decontaminate
from semiflow.llm.common import folded, source_spans


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=70), st.text(alphabet="abc ", max_size=40))
def test_myers_matches_the_table(p, t):
    assert decontaminate.myers(p, t)[0] == distance(p, t)


def edited(s, k, r):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s))
        r.choice([lambda: s.pop(i), lambda: s.insert(i, "q"), lambda: s.__setitem__(i, "z")])()
    return "".join(s)


def test_no_match_within_the_budget_is_lost(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(4, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (0, None)]
    docs = []
    for d in range(60):
        body = " ".join(word() for _ in range(60))
        if d % 2:
            item = items[d % 12][1]
            k = decontaminate.budget(len(item))
            body = f"{body[:90]} {edited(item, r.randint(0, k + 3), r)} {body[90:]}"
        docs.append((d, body.upper() if d % 3 else body))
    got = {(x.doc_id, x.item_id): x for x in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, item in items:
        if item and folded(item):
            for d, text in docs:
                best = distance(folded(item), folded(text))
                if len(folded(item)) < decontaminate.LEAST or decontaminate.budget(len(folded(item))) == 0:
                    best = 0 if len(folded(item)) >= decontaminate.LEAST and f" {folded(item)} " in f" {folded(text)} " else 99
                assert ((d, i) in got) == (best <= decontaminate.budget(len(folded(item))))
                if (d, i) in got:
                    assert got[d, i].distance == best


def test_spans_and_edges(spark):
    docs = spark.createDataFrame([(1, "É: The  Cat sat, on the mat!", 0), (2, None, 0), (3, "", 0), (None, "the cat sat on the mat", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, "the cat sat on the mat")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.distance, r.start, r.end) for r in decontaminate.matches(docs, items).collect()}
    assert got == {1: (9, 0, 3, 27), None: (9, 0, 0, 22)}
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs, items).collect()) == [2, 3]
    assert decontaminate.matches(docs.limit(0), items).collect() == [] and decontaminate.matches(docs, items.limit(0)).collect() == []
    assert source_spans("", [(0, 0)]) == [(0, 0)]


def test_tiny_and_equal_items_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a plain text about tables", 1), (2, "x" * 1_000_000 + " one short sentence " + "y " * 500_000, 1), (3, "none short sentences", 1), (3, "none short sentences", 1)], "doc_id long, text string, distance int")
    items = spark.createDataFrame([(1, "a"), (2, "one short sentence"), (3, "One short, sentence!"), (4, "tab")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.matches(docs, items).collect())
    assert got == [(2, 2, 1_000_001, 1_000_019), (2, 3, 1_000_001, 1_000_019)]
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs, items).collect()) == [1, 3, 3]
