"""Arithmetic of natural numbers in long columns: subtraction stops at 0, division by zero has a value, overflow raises."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def inc(a: Column) -> Column:
    return a + 1


def dec(a: Column) -> Column:
    return minus(a, F.lit(1))


def mod(a: Column, b: Column) -> Column:
    """a where b is 0."""
    return F.when(b == 0, a).otherwise(F.try_mod(a, b))


def quot(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, F.when(b != 0, b)))


def even(a: Column) -> Column:
    return a % 2 == 0


def odd(a: Column) -> Column:
    return a % 2 != 0


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def signed_quot(a: Column, b: Column) -> Column:
    """Division of signed integers, towards zero."""
    return F.call_function("div", a, b)
