"""Least fixpoints: a relation grown by a step until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semiflow.inference import semiring
from semiflow.scratch import cut, forget


class NotConverged(RuntimeError):
    pass


def naive(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """Applies the step to all rows each round."""
    all_rows, n = cut(start.distinct(), "fix"), -1
    for _ in range(max_rounds):
        size = all_rows.count()
        if size == n:
            return all_rows
        old, n = all_rows, size
        all_rows = cut(old.union(step(old)).distinct(), "fix")
        forget(old)
    raise NotConverged(f"not at rest after {max_rounds} rounds")


def seminaive(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """Applies the step to each round's new rows only. The step must distribute over unions."""
    new = cut(start.distinct(), "fix")
    found = [new]
    for _ in range(max_rounds):
        known = found[0]
        for f in found[1:]:
            known = known.union(f)
        on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in start.columns]
        new = cut(step(new).distinct().alias("n").join(known.alias("k"), on, "left_anti"), "fix")
        if new.isEmpty():
            return known
        found.append(new)
        if len(found) > 8:
            # new itself stays: the next round starts from it.
            old, found = found[:-1], [cut(known.union(new), "fix")]
            forget(*old)
    raise NotConverged(f"not at rest after {max_rounds} rounds")


def reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All pairs (a, b) joined by a path."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(True).alias(semiring.S))
    return semiring.closure(e, semiring.EXISTENCE).select("a", "b")
