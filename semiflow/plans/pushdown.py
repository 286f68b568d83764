"""Aggregates pushed through joins.

Catalyst leaves an aggregate above its join, so that a many-to-many join is made pair by pair. Where what is summed is a
product of a factor of each side, each side can be summed by the join key first: the join then has a row for each key
on either side, however many pairs there are. Keys compare null-safe, as in the pipelines' joins; a null factor makes its
pair's product null, which a sum leaves out. All sums are over exact types or reassociated doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semiflow.operators.flow import holds


def _by_key(df: DataFrame, key: Column, *aggs: Column) -> DataFrame:
    return df.groupBy(key.alias("k")).agg(*aggs)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k"))).drop("__k")


def count_through_join(left: DataFrame, right: DataFrame, lk: Column, rk: Column) -> DataFrame:
    """One row: how many pairs the join has."""
    a, b = _by_key(left, lk, F.count("*").alias("a")), _by_key(right, rk, F.count("*").alias("b"))
    return _met(a, b).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


def sum_through_join(left: DataFrame, right: DataFrame, lk: Column, rk: Column, f: Column | None = None, g: Column | None = None, when_left: Column | None = None, when_right: Column | None = None, of_key=None) -> DataFrame:
    """One row: the sum over the join's pairs of f(left) * g(right) * of_key(key), guards on either side held.

    f, g and of_key count as 1 where they are left out.
    """
    left = left if when_left is None else left.filter(holds(when_left))
    right = right if when_right is None else right.filter(holds(when_right))
    one = F.lit(1).cast("long")
    a = _by_key(left, lk, F.sum(one if f is None else f).alias("a"))
    b = _by_key(right, rk, F.sum(one if g is None else g).alias("b"))
    each = F.col("a") * F.col("b")
    if of_key is not None:
        each = each * of_key(F.col("k"))
    return _met(a, b).agg(F.coalesce(F.sum(each), F.lit(0)).alias("value"))


def group_sum_through_join(left: DataFrame, right: DataFrame, lk: Column, rk: Column, group: Column, g: Column, name: str = "value", f: Column | None = None) -> DataFrame:
    """Sums of f(left) * g(right) over the join's pairs, by a group that the left side gives."""
    b = _by_key(right, rk, F.sum(g).alias("b"))
    a = left.groupBy(lk.alias("k"), group.alias("group")).agg(F.sum(F.lit(1).cast("long") if f is None else f).alias("a"))
    return _met(a, b).groupBy("group").agg(F.sum(F.col("a") * F.col("b")).alias(name))


def sum_through_joins(first: tuple[DataFrame, Column, Column], *others: tuple[DataFrame, Column, Column]) -> DataFrame:
    """One row: the sum, over the joins of all sides on one key, of the product of the sides' factors.

    Each side is (rows, key, factor).
    """
    df, key, factor = first
    out = _by_key(df, key, F.sum(factor).alias("p"))
    for i, (d, k, f) in enumerate(others):
        out = _met(out, _by_key(d, k, F.sum(f).alias(f"q{i}"))).select("k", (F.col("p") * F.col(f"q{i}")).alias("p"))
    return out.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("value"))


def _widened(c: Column, of: DataFrame) -> Column:
    """Integers as decimals, whose sums and products go beyond 64 bits; other types stay."""
    kind = of.select(c).schema[0].dataType
    return c.cast("decimal(19, 0)") if isinstance(kind, T.IntegralType) else c


def product_of_sums(left: DataFrame, right: DataFrame, h: Column, k: Column) -> DataFrame:
    """One row: the sum of h(x) * k(y) over all pairs of two unrelated tables, without making the pairs.

    Of integers it is exact: a long where it fits in 64 bits, else a decimal of 38 digits (beyond those it raises). The type
    follows the value, so both sums are taken at once.
    """
    a, b = (d.agg(F.coalesce(F.sum(_widened(c, d)), F.lit(0)).alias(n)) for d, c, n in ((left, h, "a"), (right, k, "b")))
    out = a.crossJoin(F.broadcast(b)).select((F.col("a") * F.col("b")).alias("value"))
    if not isinstance(out.schema[0].dataType, T.DecimalType) or any(isinstance(d.select(c).schema[0].dataType, T.DecimalType) for d, c in ((left, h), (right, k))):
        return out
    value = out.first()[0]
    return left.sparkSession.range(1).select(F.lit(value).cast("long" if -(2**63) <= value < 2**63 else "decimal(38, 0)").alias("value"))


def hoisted_sum(df: DataFrame, f: Column, constant) -> DataFrame:
    """One row: the sum of f times a constant, which is multiplied once."""
    return df.agg((F.coalesce(F.sum(f), F.lit(0)) * F.lit(constant)).alias("value"))


def worth_pushing(side: DataFrame, key: Column, least: float = 2.0) -> bool:
    """Whether a key has at least `least` rows on average, by an approximate count."""
    n, keys = side.agg(F.count("*"), F.approx_count_distinct(key)).first()
    return keys > 0 and n / keys >= least
