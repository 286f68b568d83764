"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has one piece that occurs unchanged.
All items' pieces go into one Aho-Corasick automaton; a piece's hit gives a window of the text, and Myers' bit-parallel
distance (Python's long integers hold the bit vectors, so that items may have any length) settles it. Texts and items
are compared folded: letters A-Z lowered, other ASCII than letters and digits as single spaces.

Null and empty texts match nothing, null and empty items are skipped, copies of an item match each by itself, an empty
table gives no rows. Items are held in blocks of a bounded size; more items mean more passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semiflow.llm.common import folded, small_batches, source_spans

#: Characters of items that one pass holds (an automaton of some 50 bytes each), and of the shortest item.
BLOCK_CHARS, LEAST = 800_000, 12
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def budget(length: int, rate: float = 0.05, least_piece: int = 12) -> int:
    """Edits allowed for an item; pieces keep least_piece characters."""
    return max(0, min(int(rate * length), length // least_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets, whose lengths differ by 1 at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of the text, and the first end of such a one."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        #: Item ids, folded text and edits; items with equal texts are one entry.
        self.items: list[tuple[list[int], str, int]] = []
        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if len(s := folded(text or "").strip()) >= LEAST:
                ids.setdefault(s, []).append(item_id)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for s, own in ids.items():
            k = budget(len(s), rate)
            for at, piece in pieces(s, k):
                seeds.setdefault(piece, []).append((len(self.items), at))
            self.items.append((own, s, k))
        self.found = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.found.add_word(piece, (len(piece), where))
        self.found.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best place; code points of folded(text)."""
        if not self.items or not (s := folded(text)):
            return
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.found.iter(s):
            for item, at in where:
                _, p, k = self.items[item]
                lo = end + 1 - n - at
                if k == 0 and (s[max(0, lo - 1) : lo].isalnum() or s[end + 1 : end + 2].isalnum()):
                    continue
                windows.setdefault(item, []).append((max(0, lo - k), min(len(s), lo + len(p) + k)))
        for item, spans in windows.items():
            ids, p, k = self.items[item]
            if best := self.best(s, p, k, joined(spans)):
                for item_id in ids:
                    yield item_id, *best

    @staticmethod
    def best(s: str, p: str, k: int, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the first of the best places of p in the spans of s, or none within k edits."""
        best = None
        for a, b in spans:
            at = s.find(p, a, b)
            if at >= 0:
                return 0, at, at + len(p)
            d, e = myers(p, s[a:b])
            if d <= k and (best is None or d < best[0]):
                _, n = myers(p[::-1], s[max(a, a + e - len(p) - k) : a + e][::-1])
                best = (d, a + e - n, a + e)
        return best


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in lots of about BLOCK_CHARS characters."""
    rows = items.select("item_id", "text").filter(F.length("text") > 0)
    n = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for b in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best place of each item in each text; code points, end exclusive.

    docs has doc_id and text, items item_id and text.
    """
    out = None
    for own in blocks(items):

        def scan(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            match = Matcher(own, rate)
            for x in batches:
                got = []
                for i, t in zip(x.doc_id, x.text):
                    hits = list(match(t)) if t else []
                    got += [(i, item, d, lo, hi) for (item, d, _, _), (lo, hi) in zip(hits, source_spans(t, [h[2:] for h in hits]))]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "distance", "start", "end"])

        part = small_batches(docs).select("doc_id", "text").mapInPandas(scan, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def contaminated(items: list[tuple[int, str]], rate: float):
    """A column function: whether a text holds any of the items."""

    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(items, rate)
        for x in texts:
            yield pd.Series([bool(t) and any(True for _ in match(t)) for t in x], dtype=bool)

    return holds


def without_benchmark(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """The documents in which no item occurs, with their columns; documents with null text stay."""
    for own in blocks(items):
        docs = small_batches(docs).filter(~contaminated(own, rate)(F.col("text")))
    return docs
