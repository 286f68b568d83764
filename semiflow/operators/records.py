"""Records: columns of struct type, and checks of what a schema declares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(r: Column, key: str) -> Column:
    return r.getField(key)


def get_in(r: Column, *path: str) -> Column:
    for k in path:
        r = r.getField(k)
    return r


def assoc(r: Column, **fields: Column) -> Column:
    for k, v in fields.items():
        r = r.withField(k, v)
    return r


def update(r: Column, key: str, f: Callable[[Column], Column]) -> Column:
    return r.withField(key, f(r.getField(key)))


def assoc_in(r: Column, path: tuple[str, ...], v: Column) -> Column:
    return r.withField(".".join(path), v)


def update_in(r: Column, path: tuple[str, ...], f: Callable[[Column], Column]) -> Column:
    return assoc_in(r, path, f(get_in(r, *path)))


def select_keys(r: Column, *keys: str) -> Column:
    return F.struct(*[r.getField(k).alias(k) for k in keys])


def at(r: Column, df: DataFrame, column: str, i: int) -> Column:
    """The i-th field of the struct column, by position."""
    return r.getField(df.schema[column].dataType.fields[i].name)


def violations(df: DataFrame, **checks: Column) -> DataFrame:
    """A row: for each named check, the number of rows for which it isn't true."""
    return df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in checks.items()])


def valid(df: DataFrame, **checks: Column) -> DataFrame:
    return df.withColumn("valid", F.array_min(F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()])))


def conform(df: DataFrame, **checks: Column) -> DataFrame:
    """df; reading it raises at the first row that fails a check."""
    out = df
    for name, c in checks.items():
        out = out.filter(F.when(F.coalesce(c, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row fails {name}")).cast("boolean")))
    return out


def generated(spark: SparkSession, schema: str, n: int = 1000, seed: int = 7, low: dict[str, int] | None = None) -> DataFrame:
    """n rows of a schema of numbers, strings, booleans and structs of them, by hashes of the row's number; nullable fields are null now and then.

    low: the least value of a numeric field by name, where it isn't to go below.
    """
    low = low or {}

    def value(f: T.StructField, path: str) -> Column:
        h = F.xxhash64("id", F.lit(f"{seed}/{path}"))
        kind = f.dataType
        if isinstance(kind, T.StructType):
            out = F.struct(*[value(g, f"{path}.{g.name}").alias(g.name) for g in kind.fields])
        elif isinstance(kind, T.BooleanType):
            out = h % 2 == 0
        elif isinstance(kind, T.StringType):
            out = F.substring(F.lower(F.hex(h)), 1, F.pmod(h, F.lit(9)).cast("int"))
        elif isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType, T.DecimalType)):
            # Small values and large ones, both signs, unless a least value is given.
            size = F.when(F.pmod(h, F.lit(4)) == 0, F.lit(3)).otherwise(F.lit(100))
            number = F.pmod(F.shiftright(h, 8), size) - (0 if f.name in low else F.floor(size / 2))
            out = (number + low.get(f.name, 0)).cast(kind)
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                out = (out + F.pmod(h, F.lit(4)) / 4).cast(kind)
        else:
            raise ValueError(f"{path}: no rows are made of {kind.simpleString()}")
        return F.when(F.pmod(F.shiftright(h, 20), F.lit(10)) > 0, out) if f.nullable and not isinstance(kind, T.StructType) else out

    rows = spark.range(n)
    return rows.select(*[value(f, f.name).alias(f.name) for f in T._parse_datatype_string(schema).fields])


def counterexamples(spark: SparkSession, schema: str, f: Callable[[DataFrame], DataFrame], holds: Column, n: int = 1000, seed: int = 7, low: dict[str, int] | None = None) -> DataFrame:
    """Rows of f's result on generated rows for which `holds` isn't true: none, if what is claimed of f is so."""
    return f(generated(spark, schema, n, seed, low)).filter(~F.coalesce(holds, F.lit(False)))
