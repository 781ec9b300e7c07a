"""Dynamic values, kept as VARIANT: tests of their type, and typed extraction that gives null or raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: names of dynamic types, and the Spark types they are read as
KINDS = {
    "bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)",
    "f32": "float", "f64": "double", "date": "date", "time": "bigint", "date_time": "timestamp", "date_time_without_timezone": "timestamp_ntz", "decimal": "decimal(38,18)",
    "bson": "binary", "string": "string", "json": "string", "enum": "string", "url": "string", "ip_addr": "string", "timezone": "string",
}


def parse(json: Column) -> Column:
    """A dynamic value from JSON text; null if it isn't JSON."""
    return F.try_parse_json(json)


def kind_of(value: Column) -> Column:
    """The value's own type as text (BIGINT, STRING, ARRAY<...>, OBJECT<...>, VOID)."""
    return F.schema_of_variant(value)


def is_kind(value: Column, kind: str, path: str = "$") -> Column:
    """Whether the value at ``path`` can be read as ``kind`` without loss of its type: a number for numbers, text for text."""
    found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    family = KINDS[kind].split("(")[0]
    if family in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return found.rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.try_variant_get(value, path, KINDS[kind]).isNotNull()
    return found == family.upper()


def get(value: Column, kind: str, path: str = "$") -> Column:
    """The value at ``path`` as ``kind``; raises where it can't be cast."""
    return F.variant_get(value, path, KINDS.get(kind, kind))


def try_get(value: Column, kind: str, path: str = "$") -> Column:
    """As get, but null where it can't be cast: a failed downcast is a value, not an error."""
    return F.try_variant_get(value, path, KINDS.get(kind, kind))
