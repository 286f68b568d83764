"""String functions. Concatenation of rows is associative but depends on their order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def code(c: Column) -> Column:
    return F.ascii(c)


def concat_rows(df: DataFrame, value: str, *order: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The values of each group (or of all rows) in order, as one string, which must fit in memory."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*groups).agg(F.array_join(F.transform(parts, lambda p: p["__v"]), "").alias("value"))
