"""Weighted model counting: the probability that some alternative of a provenance holds, facts being independent.

By Shannon expansion on the most frequent fact, with a memo; parts of a provenance without common facts are multiplied
out. A part with more than `most` facts in alternatives of several raises: the count takes time exponential in them.
Alternatives that share no fact at all need no provenance: some_of() is an aggregate, for groups of any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TooManyFacts(ValueError):
    pass


def count(dnf: frozenset[frozenset[str]], p: dict[str, float], memo: dict | None = None, most: int = 64) -> float:
    memo = {} if memo is None else memo
    if frozenset() in dnf:
        return 1.0
    if not dnf:
        return 0.0
    if dnf in memo:
        return memo[dnf]
    parts = independent(dnf)
    if len(parts) > 1:
        none = 1.0
        for cs in parts:
            none *= 1 - count(cs, p, memo, most)
        out = 1 - none
    elif len(dnf) == 1:
        out = 1.0
        for x in next(iter(dnf)):
            out *= p[x]
    else:
        if len(facts := set().union(*dnf)) > most:
            raise TooManyFacts(f"a part of a provenance with {len(facts)} facts; at most {most} are counted")
        v = Counter(x for c in dnf for x in c).most_common(1)[0][0]
        yes = frozenset(c - {v} for c in dnf)
        no = frozenset(c for c in dnf if v not in c)
        out = p[v] * count(yes, p, memo, most) + (1 - p[v]) * count(no, p, memo, most)
    memo[dnf] = out
    return out


def independent(dnf: frozenset[frozenset[str]]) -> list[frozenset[frozenset[str]]]:
    """The alternatives in parts without common facts."""
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for c in dnf:
        first, *rest = c
        for x in rest:
            root[top(x)] = top(first)
    parts: dict[str, set] = {}
    for c in dnf:
        parts.setdefault(top(next(iter(c))), set()).add(c)
    return [frozenset(x) for x in parts.values()]


def some_of(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(keys, p): the probability that some row of each group holds, rows being independent and each having its own probability."""
    none = F.exp(F.sum(F.when(F.col(p) < 1, F.log1p(-F.col(p)))))
    return df.groupBy(*keys).agg(F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.coalesce(none, F.lit(1.0))).alias("p"))


def enumerated(dnf: frozenset[frozenset[str]], p: dict[str, float]) -> float:
    """By all worlds: for tests, up to some 18 facts."""
    names = sorted({x for c in dnf for x in c})
    total = 0.0
    for world in product([False, True], repeat=len(names)):
        true = {n for n, t in zip(names, world) if t}
        if any(c <= true for c in dnf):
            w = 1.0
            for n, t in zip(names, world):
                w *= p[n] if t else 1 - p[n]
            total += w
    return total


def weighted(p: dict[str, float] | float, most: int = 64):
    """A column function of a provenance: its probability. p: each fact's, or one for all."""

    @F.pandas_udf("double")
    def of(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in rows:
            out = []
            for alternatives in x:
                dnf = frozenset(frozenset(c) for c in alternatives)
                facts = {f for c in dnf for f in c}
                out.append(count(dnf, p if isinstance(p, dict) else dict.fromkeys(facts, p), most=most))
            yield pd.Series(out, dtype=float)

    return of
