"""License scans: fuzzy search for short notices.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece unchanged: all pieces are searched at once, each
hit gives a window as long as the notice and k more at both ends, and the regex library's bounded-error matching of the
whole notice in that window verifies the edits and reports the span. A window that shares too few three-character parts
with the notice can't hold it and isn't matched. Of places of one notice that overlap, that with the fewest edits is
kept, then the longest, then the first. Beside it, phrases are found wherever their words stand consecutively.

Words are runs of other characters than ASCII signs, A-Z lowered. Null texts count as empty, which have no words, no
labels and score 0; an empty table gives no rows; repeated rows are each scanned; texts may have any length, and each
hit costs the same in a long text as in a short one. Other columns of the input are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from semiflow.llm.common import folded, small_batches, source_spans
from semiflow.llm.decontaminate import pieces

#: Phrases that are found exactly, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that are found with errors, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the bsd license": "bsd",
    "this work is licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


#: Characters of the parts by which windows are sifted; windows of one text and notice whose results are kept.
GRAM, WINDOWS = 3, 10_000


def grams(s: str) -> set[str]:
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


def budget(notice: str) -> int:
    """Edits allowed: one in ten characters, with pieces of 6 characters at least."""
    return min(len(notice) // 10, len(notice) // 6 - 1)


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices, seeds = [], {}
        for notice, label in notices.items():
            k = budget(notice)
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((len(self.notices), at))
            self.notices.append((regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH), len(notice), k, label, grams(notice)))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def exact(self, s: str) -> list[tuple[int, str]]:
        """(place in s, label) of each phrase; s is folded, with a space at both ends."""
        found = []
        for phrase, label in self.phrases:
            at = s.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = s.find(phrase, at + 1)
        return found

    def fuzzy(self, s: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the notices."""
        if not self.notices:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.seeds.iter(s):
            for i, at in where:
                starts.setdefault(i, set()).add(end + 1 - n - at)
        found = []
        for i, own in starts.items():
            form, m, k, label, parts = self.notices[i]
            known: dict[str, tuple[int, int, int] | None] = {}
            places = set()
            for lo in own:
                a, b = max(0, lo - k), min(len(s), lo + m + k)
                window = s[a:b]
                if window not in known:
                    if len(known) == WINDOWS:
                        known.clear()
                    # An edit destroys at most GRAM of the notice's parts.
                    x = form.search(window) if len(parts & grams(window)) >= len(parts) - GRAM * k else None
                    known[window] = x and (x.start(), x.end(), sum(x.fuzzy_counts))
                if x := known[window]:
                    places.add((x[2], x[0] - x[1], a + x[0], a + x[1]))
            found += [(label, a, b, e) for e, _, a, b in apart(places)]
        return found

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        body = folded(text).rstrip(" ")
        if not body:
            return 0, 0, None, None, "", "", 0.0, []
        s = f" {body} "
        base = self.exact(s)
        first, last = (s.count(" ", 0, f(at for at, _ in base)) if base else None for f in (min, max))
        near = sorted(self.fuzzy(s), key=lambda x: x[1:])
        labels = {label for _, label in base}
        score = 1.0 if base else max((1 - e / max(1, b - a) for _, a, b, e in near), default=0.0)
        spans = source_spans(text, [(max(0, a - 1), max(0, b - 1)) for _, a, b, _ in near])
        return (
            body.count(" ") + 1, len(base), first, last,
            ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in near})), max(0.0, score),
            [{"label": x[0], "start": a, "end": b, "edits": x[3]} for x, (a, b) in zip(near, spans)],
        )


def apart(places: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of places (edits, -length, start, end), taken from the best on, those that overlap none taken before."""
    starts: list[int] = []
    kept: list[tuple[int, int, int, int]] = []
    by_start: dict[int, tuple[int, int, int, int]] = {}
    for p in sorted(places):
        i = bisect.bisect_left(starts, p[2])
        if (i < len(starts) and starts[i] < p[3]) or (i and by_start[starts[i - 1]][3] > p[2]):
            continue
        starts.insert(i, p[2])
        by_start[p[2]] = p
        kept.append(p)
    return kept


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each document (doc_id, text): counts of words and phrases, labels, score and the notices' spans in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Scanner(phrases, notices)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for x in batches:
            out = pd.DataFrame([find(t) for t in x.text], columns=names)
            out.insert(0, "doc_id", x.doc_id.values)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, SCHEMA)
