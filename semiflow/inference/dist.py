"""Finite distributions as tables (outcome, p), and Monte-Carlo sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(spark: SparkSession, weights: dict) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), ["outcome", "p"])


def uniform(df: DataFrame, column: str) -> DataFrame:
    x = df.groupBy(F.col(column).alias("outcome")).agg(F.count("*").cast("double").alias("p"))
    return normalized(x)


def bernoulli(spark: SparkSession, p: float) -> DataFrame:
    return finite(spark, {True: p, False: 1 - p})


def mapped(d: DataFrame, f: Column) -> DataFrame:
    """Outcomes through f; equal images add."""
    return d.select(f.alias("outcome"), "p").groupBy("outcome").agg(F.sum("p").alias("p"))


def bind(d: DataFrame, kernel: DataFrame) -> DataFrame:
    """kernel (given, outcome, q): the distribution of outcomes, given d's."""
    x = d.withColumnRenamed("outcome", "given").join(kernel, "given")
    return x.groupBy("outcome").agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def normalized(d: DataFrame) -> DataFrame:
    total = d.agg(F.sum("p").alias("__t"))
    return d.crossJoin(F.broadcast(total)).select("outcome", (F.col("p") / F.col("__t")).alias("p"))


def expectation(d: DataFrame, g: Column) -> DataFrame:
    return d.agg(F.coalesce(F.sum(F.col("p") * g), F.lit(0.0)).alias("value"))


def probability(d: DataFrame, event: Column) -> DataFrame:
    return expectation(d, F.when(event, 1.0).otherwise(0.0))


# Samplers: a column of independent draws.


def uniform_draw(low: float = 0.0, high: float = 1.0, seed: int = 42) -> Column:
    return F.rand(seed) * (high - low) + low


def gaussian_draw(mean: float = 0.0, sd: float = 1.0, seed: int = 42) -> Column:
    return F.randn(seed) * sd + mean


def finite_draw(weights: dict, seed: int = 42) -> Column:
    """Draws by inverse distribution function."""
    total, upto, out, u = sum(weights.values()), 0.0, None, F.rand(seed)
    for v, w in list(weights.items())[:-1]:
        upto += w / total
        out = F.when(u < upto, v) if out is None else out.when(u < upto, v)
    last = list(weights)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def sampled(spark: SparkSession, draw: Column, g: Callable[[Column], Column], n: int = 100_000) -> DataFrame:
    """One row: the mean of g over n draws."""
    return spark.range(n).select(draw.alias("x")).agg(F.avg(g(F.col("x")).cast("double")).alias("value"))
