"""Association maps in map columns; the last value written for a key stays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty(key: str, value: str) -> Column:
    return F.map_from_arrays(F.array().cast(f"array<{key}>"), F.array().cast(f"array<{value}>"))


def put(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))


def get(m: Column, k: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), default)


def size(m: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(m)), F.lit(0))
