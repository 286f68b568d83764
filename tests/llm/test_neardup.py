import random
from collections import Counter
from itertools import combinations

import numpy as np

from semiflow.llm import neardup
from semiflow.llm.common import folded


def shingles(t):
    w = folded(t or "").split()
    n = neardup.WORDS
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    text = dict(rows)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = {i: shingles(text[i]) for i in ids}
    for a, b in combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in ids}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "be", "co", "da", "el", "fi", "go"]) for _ in range(r.randint(1, 3)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 150))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 40))):
                x[r.randrange(len(x))] = word()
            rows.append(" ".join(x).capitalize() + r.choice(["", ".", "\n"]))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_chain_of_copies_is_one_class(spark):
    """Neighbours are alike, ends are not: the leader alone would miss links."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 200])) for i in range(15)]
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and set(got.values()) == {0}


def repeated_lines(pairs, times):
    """Pairs of texts whose second one has one more line, many times: the sets of shingles are over 0.8 alike."""
    rows = []
    for i in range(pairs):
        base = [f"p{i}w{k}" for k in range(154)]
        rows += [" ".join(base), " ".join(base + [f"p{i}x{k}" for k in range(30)] * times)]
    return list(enumerate(rows))


def test_lines_repeated_in_one_copy_only(spark):
    rows = repeated_lines(20, 50)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {i: i - i % 2 for i, _ in rows}


def test_signatures_agree_as_the_verified_sets_do():
    texts = [t for _, t in repeated_lines(20, 50)]
    sig = neardup.sketches(texts, neardup.Powers(), neardup.BANDS, neardup.ROWS)[3]
    true = np.mean([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2])])
    assert true > 0.8 and abs((sig[::2] == sig[1::2]).mean() - true) < 0.03


def test_nulls_empties_repeats(spark):
    rows = [(5, "a b c"), (5, "a b c"), (3, "A, b. c!"), (7, None), (8, ""), (9, "..."), (None, "a b c"), (10, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (8, 8), (9, 9), (None, None), (10, 10)], key=str)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 8, 9, 10, None], key=str)
    assert neardup.classes(docs.limit(0)).collect() == []


def test_rows_with_one_id_stand_for_their_least_text(spark):
    """Keys, sets and the kept row come from one text, so copies of the least text are found and those of others stay."""
    of = lambda i, k: f"{k} " + " ".join(f"t{i}{k}{j}" for j in range(40))
    rows = [x for i in range(12) for x in [(2 * i + 1, of(i, "z")), (2 * i + 1, of(i, "a")), (2 * i + 1, of(i, "m")), (2 * i, of(i, "a"))]]
    rows += [(101, of(50, "z")), (101, of(50, "a")), (102, of(50, "z"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {2 * i: of(i, "a") for i in range(12)} | {101: of(50, "a"), 102: of(50, "z")}
    assert sorted(map(tuple, neardup.deduplicated(docs).collect())) == sorted(want.items())


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(range(0, 60), r.uniform(0.5, 3, 60))}
    b = {int(k): float(w) for k, w in zip(range(20, 80), r.uniform(0.5, 3, 60))}
    true = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    ids = neardup.mixed(np.array([*a, *b], np.uint64))
    doc = np.array([0] * 60 + [1] * 60)
    sig = neardup.probminhash(ids, np.array([*a.values(), *b.values()]), doc, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def times_of(t):
    w, n = folded(t or "").split(), neardup.WORDS
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def probability(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())


def test_probability_jaccard_matches_the_formula():
    r = random.Random(8)
    for _ in range(40):
        x, y = (Counter({k: r.randint(1, 5) for k in r.sample(range(20), r.randint(1, 12))}) for _ in range(2))
        arrays = [np.array(v) for z in (x, y) for v in (sorted(z), [z[k] for k in sorted(z)])]
        assert abs(neardup.probability_jaccard(*arrays) - probability(x, y)) < 1e-9


def test_shingles_weighed_by_times_match_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(30):
        base = [f"p{i}w{k}" for k in range(40)]
        line = [f"p{i}x{k}" for k in range(6)]
        rows += [base + line * 10, base + line * r.choice([8, 10, 12, 60])]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), by_times=True).collect()}
    want = {i: i for i, _ in rows}
    for i in range(0, 60, 2):
        if probability(times_of(rows[i][1]), times_of(rows[i + 1][1])) >= 0.8:
            want[i + 1] = i
    assert got == want and 5 < sum(a != b for a, b in want.items()) < 30


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 50_021}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 500_000), (4, "x" * 500_000 + " y")]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    p = neardup.Powers()
    words = folded(long).split()
    assert len(neardup.shingle_hashes(long, p)) == len(words) - 4 and len(p.up) < 4 * neardup.CHUNK


def test_shingle_hashes_follow_words():
    p = neardup.Powers()
    a = neardup.shingle_hashes("The cat, sat on THE mat again", p)
    b = neardup.shingle_hashes("x the cat sat on the mat again", p)
    assert len(a) == 3 and set(a) < set(b)
    assert len(neardup.shingle_hashes("one", p)) == 1 and len(neardup.shingle_hashes("", p)) == 0
