"""Views kept up to date by deltas.

A query is a join of two inputs, or one input, followed by filters and maps and at most one weighted sum, all of which
are linear or bilinear, so that a view's change follows from the inputs' changes. An input's state is the written tables
of its deltas: a step writes its own delta only, and after COMPACT of them they are consolidated into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semiflow.scratch import cut, forget
from semiflow.streaming import zset


class NotIncremental(ValueError):
    """The operation can't be kept up to date by deltas."""


LINEAR = ("filter", "map", "foreign", "sum", "count")
#: Deltas after which an input's state is consolidated.
COMPACT = 8


@dataclass
class State:
    """All that an input has been so far, as the written tables of its deltas."""

    parts: list[DataFrame] = field(default_factory=list)

    def whole(self, like: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts, like.limit(0))

    def append(self, delta: DataFrame) -> None:
        """delta has been written."""
        self.parts.append(delta)
        if len(self.parts) > COMPACT:
            old, self.parts = self.parts, [cut(zset.consolidate(self.whole(delta)), "state")]
            forget(*old)


@dataclass
class JoinView:
    """The join of two weighted inputs; step() takes their changes and gives the view's change."""

    on: tuple[Column, Column]
    left: State = field(default_factory=State)
    right: State = field(default_factory=State)

    def step(self, dl: DataFrame, dr: DataFrame) -> DataFrame:
        a, b = self.on
        dl, dr = cut(dl, "left"), cut(dr, "right")
        new = zset.join(dl, self.right.whole(dr), a, b).unionByName(zset.join(self.left.whole(dl), dr, a, b)).unionByName(zset.join(dl, dr, a, b))
        new = cut(zset.consolidate(new), "change")
        self.left.append(dl)
        self.right.append(dr)
        return new


@dataclass
class Query:
    """stages: ("filter", p), ("map", [exprs]), ("foreign", name, [exprs]), ("sum", f) or ("count",), the last two at the end only.

    A foreign stage is a map by a function from outside: that it gives equal images for equal elements is trusted.
    """

    stages: list[tuple]
    join: tuple[Column, Column] | None = None
    notes: list[str] = field(default_factory=list)

    def __post_init__(self):
        for i, s in enumerate(self.stages):
            if s[0] not in LINEAR:
                raise NotIncremental(s[0])
            if s[0] in ("sum", "count") and i < len(self.stages) - 1:
                raise NotIncremental(f"{s[0]} before the end")
        named = [f"foreign {s[1]}: linear (trusted)" if s[0] == "foreign" else f"{s[0]}: linear" for s in self.stages]
        self.notes = ["join: bilinear"] * (self.join is not None) + named

    def linear(self, z: DataFrame) -> DataFrame:
        for s in self.stages:
            if s[0] == "filter":
                z = zset.where(z, s[1])
            elif s[0] == "map":
                z = zset.project(z, *s[1])
            elif s[0] == "foreign":
                z = zset.project(z, *s[2])
            elif s[0] == "sum":
                z = zset.total(z, s[1])
            else:
                z = zset.cardinality(z)
        return z

    def batch(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """From the whole inputs: what the increments must add up to."""
        return self.linear(left if right is None else zset.join(left, right, *self.join))

    @property
    def folds(self) -> bool:
        return bool(self.stages) and self.stages[-1][0] in ("sum", "count")

    def changes(self, deltas: Iterable[tuple[DataFrame, ...]]) -> DataFrame:
        """The view's change at each delta: a column step, counted from 0, before the view's own."""
        view, out = JoinView(self.join) if self.join is not None else None, None
        for i, d in enumerate(deltas):
            change = self.linear(d[0] if view is None else view.step(*d))
            change = change.select(F.lit(i).cast("long").alias("step"), "*")
            out = change if out is None else out.unionByName(change)
        return out

    def running(self, deltas: Iterable[tuple[DataFrame, ...]]) -> DataFrame:
        """(step, value): the sum or count after each delta."""
        if not self.folds:
            raise NotIncremental("running values are those of a sum or count: views() gives tables")
        return running(self.changes(deltas))

    def run(self, deltas: Iterable[tuple[DataFrame, ...]]) -> list[DataFrame]:
        """The view after each delta, consolidated."""
        deltas = list(deltas)
        every = cut(self.changes(deltas), "changes")
        return [zset.consolidate(every.filter(F.col("step") <= i).drop("step")) for i in range(len(deltas))]


def running(changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, step, value): running sums of changes (by, step, value), of which each step has a row."""
    upto = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(*by, "step", F.sum("value").over(upto).alias("value"))


def per_batch(values: DataFrame, combine: Callable[[Column], Column]) -> DataFrame:
    """(step, value): running combination, by an aggregate, of each step's own value (step, value); a row for each step."""
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return values.select("step", combine(F.col("value")).over(upto).alias("value"))


def every_nth(n: int, changes: DataFrame) -> DataFrame:
    """Changes (step, elements, _w) on a slower clock: n steps at a time, consolidated; the rest at the end."""
    return zset.consolidate(changes.withColumn("step", F.floor(F.col("step") / n)))


def rebuild(delta_rows: int, fanout: float, base_rows: int) -> str:
    """Whether to apply a delta or to recompute."""
    return "incremental" if delta_rows * max(1.0, fanout) < base_rows else "batch"


def mode(*inputs: DataFrame) -> str:
    """The mode that covers all inputs: batch is below stream."""
    return "stream" if any(d.isStreaming for d in inputs) else "batch"


def bounded(df: DataFrame, verb: str) -> DataFrame:
    """df, unless it never ends and the verb needs its end."""
    if df.isStreaming:
        raise NotIncremental(f"{verb} needs the end of its input: take a window of the stream first")
    return df


# Streams as tables (t, value): the calculus of differences.


def delay(s: DataFrame) -> DataFrame:
    """Values one step later, 0 at the first."""
    after = s.select((F.col("t") + 1).alias("t"), F.col("value").alias("__v"))
    return s.select("t").join(after, "t", "left").select("t", F.coalesce("__v", F.lit(0)).alias("value"))


def difference(s: DataFrame) -> DataFrame:
    d = delay(s).withColumnRenamed("value", "__d")
    return s.join(d, "t").select("t", (F.col("value") - F.col("__d")).alias("value"))


def integral(s: DataFrame) -> DataFrame:
    """Running sums, in parallel over ranges of t."""
    from semiflow.operators.flow import Flow

    x = Flow(s, ("t",)).reductions(F.col("value"), 0).df.filter("_pos > 0")
    at = Flow(s, ("t",)).indexed().df.select((F.col("_pos") + 1).alias("_pos"), "t")
    return x.join(at, "_pos").select("t", "value")
