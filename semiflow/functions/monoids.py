"""Associative operations, the laws that hold for them, and folds that rely on those laws.

A fold is split over partitions only if its operation is associative and has an identity; the order of rows may be
ignored only if it is commutative as well; a row may be counted twice only if it is idempotent. Declared laws of
operations from outside are trusted, and test_laws() looks for counterexamples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    name: str
    identity: object
    #: The operation on two columns, on two Python values, and as an aggregate, where Spark has one.
    columns: Callable[[Column, Column], Column]
    values: Callable
    aggregate: Callable[[Column], Column] | None = None
    laws: frozenset[str] = field(default=frozenset({"associative"}))
    trusted: bool = False

    def can(self, *laws: str) -> bool:
        return set(laws) <= self.laws


AC, ACI = frozenset({"associative", "commutative"}), frozenset({"associative", "commutative", "idempotent"})
REGISTRY: dict[str, Monoid] = {}


def register(m: Monoid) -> Monoid:
    REGISTRY[m.name] = m
    return m


PLUS = register(Monoid("+", 0, lambda a, b: a + b, lambda a, b: a + b, F.sum, AC))
TIMES = register(Monoid("*", 1, lambda a, b: a * b, lambda a, b: a * b, F.product, AC))
MAX = register(Monoid("max", 0, F.greatest, max, F.max, ACI))
OR = register(Monoid("or", False, lambda a, b: a | b, lambda a, b: a or b, F.bool_or, ACI))
AND = register(Monoid("and", True, lambda a, b: a & b, lambda a, b: a and b, F.bool_and, ACI))
BIT_OR = register(Monoid("bit-or", 0, lambda a, b: a.bitwiseOR(b), lambda a, b: a | b, F.bit_or, ACI))
BIT_XOR = register(Monoid("bit-xor", 0, lambda a, b: a.bitwiseXOR(b), lambda a, b: a ^ b, F.bit_xor, AC))
TEXT = register(Monoid("str", "", F.concat, lambda a, b: a + b, None, frozenset({"associative"})))


def foreign(name: str, identity, values: Callable, laws: set[str]) -> Monoid:
    """An operation from outside with asserted laws."""
    return register(Monoid(name, identity, lambda a, b: None, values, None, frozenset(laws), True))


def broken_laws(m: Monoid, samples: list) -> list[str]:
    """Of the laws that m claims, those that the samples contradict."""
    f, bad = m.values, []
    if any(f(m.identity, a) != a or f(a, m.identity) != a for a in samples):
        bad.append("identity")
    if m.can("associative") and any(f(f(a, b), c) != f(a, f(b, c)) for a, b, c in product(samples, repeat=3)):
        bad.append("associative")
    if m.can("commutative") and any(f(a, b) != f(b, a) for a, b in product(samples, repeat=2)):
        bad.append("commutative")
    if m.can("idempotent") and any(f(a, a) != a for a in samples):
        bad.append("idempotent")
    return bad


def fold(df: DataFrame, m: Monoid, value: Column, init=None) -> DataFrame:
    """One row: the fold of all values, combined once with init, in the values' own type. Raises for operations that need an order."""
    if not m.can("associative", "commutative"):
        raise ValueError(f"{m.name} isn't commutative: rows have no order here")
    init = m.identity if init is None else init
    x = df.select(F.lit(0).alias("k"), value.alias("v"))
    kind = dict(x.dtypes)["v"]
    if m.aggregate is not None and not (m.name == "*" and kind.startswith("decimal")):  # Spark's product is a double
        return df.agg(m.aggregate(value).alias("__a")).select(m.columns(F.lit(init), F.coalesce("__a", F.lit(m.identity))).alias("value"))
    found = [r[0] for r in merge_by(x, m, "k", "v").select("v").collect()]
    start = [type(v)(init) for v in found] or [Decimal(init) if kind.startswith("decimal") else init]
    return df.sparkSession.createDataFrame([(m.values(start[0], found[0]) if found else start[0],)], f"value {kind}")


def group_by(df: DataFrame, m: Monoid, key: str, value: Column, name: str = "value") -> DataFrame:
    """A row for each key: the fold of its values, in their own type."""
    if m.aggregate is not None:
        return df.groupBy(key).agg(m.aggregate(value).alias(name))
    return merge_by(df.select(F.col(key), value.alias(name)), m, key, name)


def merge_by(df: DataFrame, m: Monoid, key: str, value: str, salts: int = 32) -> DataFrame:
    """Per-key folds of an operation in Python: first in each partition's batches, then by salted key, then by key.

    Each step leaves at most a row for each key and task, so that a key with many rows never meets in one task whole.
    Keys and values keep their types; the operation sees Python values, and nulls are left out, as by other aggregates.
    """
    if not m.can("associative", "commutative"):
        raise ValueError(f"{m.name} can't be split: it isn't associative and commutative")
    schema = df.select(key, value).schema

    def both(a, b):
        return b if a is None else a if b is None else m.values(a, b)

    def rows(batch):
        return zip(*(c.to_pylist() for c in batch.columns))

    def made(pairs, like):
        columns = list(zip(*pairs)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, like.field(i).type) for i, c in enumerate(columns)], names=[key, value])

    def partial(batches):
        acc: dict = {}
        like = None
        for b in batches:
            like = b.schema
            for k, v in rows(b):
                acc[k] = both(acc[k], v) if k in acc else v
            if len(acc) > 100_000:
                yield made(acc.items(), like)
                acc = {}
        if acc:
            yield made(acc.items(), like)

    def runs(batches):
        """Folds rows of one key that follow each other."""
        out: list = []
        like = None
        for b in batches:
            like = b.schema
            for k, v in rows(b):
                if out and out[-1][0] == k:
                    out[-1] = (k, both(out[-1][1], v))
                else:
                    out.append((k, v))
            if len(out) > 100_000:
                yield made(out[:-1], like)
                out = out[-1:]
        if out:
            yield made(out, like)

    x = df.select(key, value).mapInArrow(partial, schema).withColumn("__s", F.spark_partition_id() % salts)
    for dealt in ([key, "__s"], [key]):
        x = x.repartition(*dealt).sortWithinPartitions(key).select(key, value).mapInArrow(runs, schema)
    return x
