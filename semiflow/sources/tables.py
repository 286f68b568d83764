"""Where rows come from and go to."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A file or folder; json and csv need a schema, so that reading them takes one pass."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    w = df.write.mode(mode).options(**options).format(kind)
    (w.partitionBy(*by) if by else w).save(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database's table, read in parallel by ranges of a numeric key."""
    return spark.read.jdbc(url, name, key, low, high, parts)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Rows of a SQL query over the given tables."""
    return spark.sql(sql, **tables)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 to n - 1, as `value`; of the endless range, what a take of n needs."""
    return spark.range(n).withColumnRenamed("id", "value")


def unfolded(spark: SparkSession, step: Callable, seed, n: int, schema: str) -> DataFrame:
    """At most n values of a step that gives (value, next seed) or None; each depends on the last, so the driver makes them."""
    out = []
    for _ in range(n):
        got = step(seed)
        if got is None:
            break
        value, seed = got
        out.append((len(out), value))
    return spark.createDataFrame(out, f"_pos long, {schema}")


OPS: dict[str, Callable[[Column, object], Column]] = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "=": Column.__eq__}


def where(df: DataFrame, *predicates: tuple[str, str, object]) -> DataFrame:
    """Rows for which all (column, op, value) hold."""
    for _, op, _ in predicates:
        if op not in OPS:
            raise ValueError(f"no such comparison: {op}")
    return df.filter(reduce(Column.__and__, (OPS[op](F.col(c), v) for c, op, v in predicates), F.lit(True)))


def triples(df: DataFrame, key: str) -> DataFrame:
    """(e, a, v): a row for each non-null attribute of each entity, values as text."""
    rest = [c for c in df.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("a"), F.col(c).cast("string").alias("v")) for c in rest])
    return df.select(F.col(key).alias("e"), F.explode(pairs).alias("p")).select("e", "p.a", "p.v").filter("v is not null")


def attribute(t: DataFrame, a: str) -> DataFrame:
    return t.filter(F.col("a") == a).select("e", F.col("v").alias(a))


def entity_join(t: DataFrame, *attributes: str) -> DataFrame:
    """Entities that have all the attributes, with their values."""
    out = attribute(t, attributes[0])
    for a in attributes[1:]:
        out = out.join(attribute(t, a), "e")
    return out


def shaped(df: DataFrame, find: str):
    """A result in the shape of its find clause: scalar, coll(ection), tuple or rel(ation)."""
    if find == "rel":
        return df
    if find == "coll":
        return [r[0] for r in df.collect()]
    row = df.first()
    return None if row is None else row[0] if find == "scalar" else tuple(row)
