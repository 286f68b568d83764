import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from semiflow.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    hits = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["cc", "BY", "by", "General", "public", "License", "all", "rights", "reserved", "é", " ", ", ", "\n", "-", "x1", "\x7f", "\u00a0"]), max_size=25))
def test_base_matches_brute_force(parts):
    text = " ".join(parts)
    assert ls.Scanner(ls.PHRASES, {})(text)[:5] == brute(text)
    text = "".join(parts)
    assert ls.Scanner(ls.PHRASES, {})(text)[:5] == brute(text)


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_fuzzy_matches_brute_force():
    r, find = random.Random(5), ls.Scanner({}, ls.NOTICES)
    for n in range(120):
        notice = r.choice(list(ls.NOTICES))
        s = list(notice)
        for _ in range(r.randint(0, ls.budget(notice) + 3)):
            i = r.randrange(len(s))
            r.choice([lambda i=i: s.pop(i), lambda i=i: s.insert(i, r.choice("xe ")), lambda i=i: s.__setitem__(i, "z")])()
        text = f" before {''.join(s)} after {notice[: r.randint(0, 20)]} end "
        got = {}
        for label, a, b, e in find.fuzzy(text):
            got[label] = min(e, got.get(label, 99))
            assert 0 <= a < b <= len(text)
        want = {}
        for p, label in ls.NOTICES.items():
            if (d := least_edits(p, text)) <= ls.budget(p):
                want[label] = min(d, want.get(label, 99))
        assert got == want


def test_repeated_openings_are_quick():
    find = ls.Scanner(ls.PHRASES, ls.NOTICES)
    for t in ("permission is hereby " * 48_000, "redistribution and use in source " * 30_000, "cc by " * 160_000):
        began = time.process_time()
        find(t)
        assert time.process_time() - began < 3, t[:20]


def test_fuzzy_notices_and_spans(spark):
    rows = [
        (1, "Intro. Licensed under the Apache Licence, Version 2.0. End", 0), (2, "All rights reserved.", 0), (3, None, 0), (4, "", 0), (5, "plain " * 30_000, 0),
        (6, "Permision is hereby granted, free of charge, to any persn obtaining a copy", 0), (None, "cc by cc by", 0), (7, "...", 0),
    ]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()}
    assert got[1].labels == "apache" and got[1].base_labels == "" and 0.9 < got[1].score < 1
    text, (span,) = rows[0][1], got[1].spans
    assert text[span.start : span.end].startswith("Licensed under") and span.edits == 1
    assert got[2].labels == "reserved" and got[2].score == 1.0
    assert [(got[i].n_words, got[i].score, got[i].labels) for i in (3, 4, 7)] == [(0, 0.0, "")] * 3
    assert got[5].n_words == 30_000 and got[5].score == 0
    assert got[6].labels == "mit"
    assert (got[None].n_base, got[None].first_word, got[None].last_word) == (2, 0, 2)
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
