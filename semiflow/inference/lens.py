"""Lenses: a part of a row that can be read and replaced; and of views whose edits go back to their source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semiflow.streaming import zset


@dataclass(frozen=True)
class Lens:
    get: Callable[[Column], Column]
    put: Callable[[Column, Column], Column]

    def then(self, inner: Lens) -> Lens:
        return Lens(lambda r: inner.get(self.get(r)), lambda r, v: self.put(r, inner.put(self.get(r), v)))


def key(name: str) -> Lens:
    return Lens(lambda r: r.getField(name), lambda r, v: r.withField(name, v))


def round_trips(lens: Lens, r: Column, v: Column) -> Column:
    """What was put is got, and putting what is there changes nothing."""
    return lens.get(lens.put(r, v)).eqNullSafe(v) & lens.put(r, lens.get(r)).eqNullSafe(r)


def filtered_edit(source: DataFrame, p: Column, delta: DataFrame) -> DataFrame:
    """A delta of the view `filter p` as a delta of its source. Rows that the view can't hold raise."""
    ok = F.when(F.coalesce(p, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("an edit outside the view")).cast("boolean"))
    return zset.add(source, delta.filter(ok))


def field_edit(source: DataFrame, id_column: str, field: str, edits: DataFrame) -> DataFrame:
    """The delta that gives the field new values: edits (id, value). Old rows are retracted, new ones inserted."""
    e = edits.select(F.col(id_column), F.col("value").alias("__v"))
    hit = source.join(e, id_column)
    old = hit.drop("__v").select(*source.columns).withColumn(zset.W, F.lit(-1).cast("long"))
    new = hit.withColumn(field, F.col("__v")).select(*source.columns).withColumn(zset.W, F.lit(1).cast("long"))
    return zset.consolidate(old.unionByName(new))
