"""Values that may be absent, as nullable columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    return c.isNotNull()


def absent(c: Column) -> Column:
    return c.isNull()


def or_else(c: Column, default: Column) -> Column:
    return F.coalesce(c, default)


def elim(c: Column, none: Column, some: Callable[[Column], Column]) -> Column:
    return F.when(c.isNull(), none).otherwise(some(c))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(c.isNotNull(), f(c))
