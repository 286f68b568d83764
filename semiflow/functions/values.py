"""Values of no fixed type, as variants read from JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names and the schema that Spark reports for a variant of the type.
TYPES = {"int": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "nil": "VOID", "map": "OBJECT", "vector": "ARRAY", "double": "DOUBLE", "decimal": "DECIMAL"}


def value(json: Column) -> Column:
    return F.try_parse_json(json)


def get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def is_type(v: Column, name: str) -> Column:
    if name in ("some", "any"):
        return v.isNotNull()
    s = F.schema_of_variant(v)
    if name in ("double", "float"):
        return F.coalesce(s.startswith("DOUBLE") | s.startswith("DECIMAL") | s.startswith("FLOAT"), F.lit(False))
    return F.coalesce(s.startswith(TYPES[name]), F.lit(False))


def to_json(v: Column) -> Column:
    return F.to_json(v)
