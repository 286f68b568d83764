"""Weighted sets: rows with a weight _w, negative for retractions; a row counts as the sum of its weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "_w"


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def zset(df: DataFrame, weight: int | Column = 1) -> DataFrame:
    return df.withColumn(W, (F.lit(weight) if isinstance(weight, int) else weight).cast("long"))


def consolidate(z: DataFrame) -> DataFrame:
    """A row for each element whose weights don't cancel."""
    return z.groupBy(*columns(z)).agg(F.sum(W).alias(W)).filter(F.col(W) != 0)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(a.unionByName(b))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def where(z: DataFrame, p: Column) -> DataFrame:
    return z.filter(p)


def project(z: DataFrame, *exprs: Column) -> DataFrame:
    """Elements mapped to the expressions; equal images add."""
    return consolidate(z.select(*exprs, W))


def total(z: DataFrame, f: Column) -> DataFrame:
    """One row: the weighted sum of f, 0 for no rows."""
    return z.agg(F.coalesce(F.sum(F.col(W) * f), F.lit(0)).alias("value"))


def cardinality(z: DataFrame) -> DataFrame:
    return total(z, F.lit(1))


def join(a: DataFrame, b: DataFrame, ka: Column, kb: Column) -> DataFrame:
    """Pairs with equal keys, columns prefixed by l_ and r_; weights multiply."""
    x = a.select(ka.alias("__k"), F.col(W).alias("__wl"), *[F.col(c).alias(f"l_{c}") for c in columns(a)])
    y = b.select(kb.alias("__m"), F.col(W).alias("__wr"), *[F.col(c).alias(f"r_{c}") for c in columns(b)])
    return x.join(y, F.col("__k").eqNullSafe(F.col("__m"))).withColumn(W, F.col("__wl") * F.col("__wr")).drop("__k", "__m", "__wl", "__wr")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs; weights multiply. For small sets."""
    return join(a, b, F.lit(1), F.lit(1))


def distinct(z: DataFrame) -> DataFrame:
    """Elements of positive weight, once each."""
    return consolidate(z).filter(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))
