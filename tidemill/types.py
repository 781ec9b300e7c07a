"""Row types: dataclasses as schemas, the map from logical to Spark types, and strict reading.

``record`` turns a dataclass into a StructType; ``field(name=...)`` renames a column. ``strict_read`` raises where a
file lacks a column or has it with another type, instead of giving nulls.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import types as pytypes
import typing
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class _Named:
    """A logical type without a Python class of its own."""

    def __init__(self, name: str, spark: T.DataType) -> None:
        self.name, self.spark = name, spark

    def __repr__(self) -> str:
        return self.name


#: Unsigned numbers take the next wider signed type; the widest becomes a decimal, as in Parquet reading.
I8, I16, I32, I64 = _Named("i8", T.ByteType()), _Named("i16", T.ShortType()), _Named("i32", T.IntegerType()), _Named("i64", T.LongType())
U8, U16, U32, U64 = _Named("u8", T.ShortType()), _Named("u16", T.IntegerType()), _Named("u32", T.LongType()), _Named("u64", T.DecimalType(20, 0))
F32, F64 = _Named("f32", T.FloatType()), _Named("f64", T.DoubleType())
NaiveDateTime = _Named("datetime without zone", T.TimestampNTZType())
TimeOfDay = _Named("time, in nanoseconds of the day", T.LongType())
Json, Enum, Url, IpAddr, Timezone = (_Named(n, T.StringType()) for n in ("json", "enum", "url", "ip address", "timezone"))
Bson = _Named("bson", T.BinaryType())
Value = _Named("value", T.VariantType())
Duration = _Named("duration", T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("micros", T.LongType())]))
Webpage = _Named("webpage", T.StructType([T.StructField("ip", T.StringType()), T.StructField("url", T.StringType()), T.StructField("contents", T.BinaryType())]))

_PYTHON = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), dt.date: T.DateType(), dt.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}


def decimal_type(precision: int, scale: int) -> _Named:
    return _Named(f"decimal({precision},{scale})", T.DecimalType(precision, scale))


def field(*, name: str | None = None, default: Any = dataclasses.MISSING) -> Any:
    """A dataclass field whose column has another name."""
    return dataclasses.field(default=default, metadata={"name": name} if name else {})


def spark_type(kind: Any) -> tuple[T.DataType, bool]:
    """The Spark type of a Python annotation, and whether it may be null (Optional)."""
    if isinstance(kind, _Named):
        return kind.spark, False
    if isinstance(kind, T.DataType):
        return kind, False
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, pytypes.UnionType):
        inner = [a for a in args if a is not type(None)]
        if len(inner) != 1:
            raise TypeError(f"only Optional unions have a column type: {kind}")
        return spark_type(inner[0])[0], len(inner) < len(args)
    if origin is list:
        inner, null = spark_type(args[0])
        return T.ArrayType(inner, null), False
    if origin is dict:
        k, v = spark_type(args[0]), spark_type(args[1])
        return T.MapType(k[0], v[0], v[1]), False
    if origin is tuple:
        parts = [spark_type(a) for a in args]
        return T.StructType([T.StructField(f"_{i + 1}", p, n) for i, (p, n) in enumerate(parts)]), False
    if dataclasses.is_dataclass(kind):
        return schema_of(kind), False
    if kind in _PYTHON:
        return _PYTHON[kind], False
    raise TypeError(f"no column type for {kind!r}")


def schema_of(cls: type) -> T.StructType:
    """The schema of a dataclass, nested ones included."""
    hints = {f.name: f.type for f in dataclasses.fields(cls)}
    if any(isinstance(x, str) for x in hints.values()):
        module = __import__(cls.__module__, fromlist=["_"])
        hints = {k: eval(x, vars(module) | {"Optional": typing.Optional}) if isinstance(x, str) else x for k, x in hints.items()}  # noqa: S307
    out = []
    for f in dataclasses.fields(cls):
        kind, null = spark_type(hints[f.name])
        out.append(T.StructField(f.metadata.get("name", f.name), kind, null))
    return T.StructType(out)


def record(cls: type) -> type:
    """Class decorator: a dataclass with a ``schema`` attribute."""
    out = dataclasses.dataclass(cls)
    out.schema = schema_of(out)
    return out


def as_schema(schema: Any) -> T.StructType | None:
    """A StructType from one, a DDL string, a record class, or None."""
    if schema is None or isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    if dataclasses.is_dataclass(schema):
        return getattr(schema, "schema", None) or schema_of(schema)
    raise TypeError(f"not a schema: {schema!r}")


def _bare(kind: T.DataType) -> str:
    return kind.simpleString()


def check_columns(found: T.StructType, wanted: T.StructType, *, check_types: bool = True) -> None:
    """Raise ValueError, with both schemas, where ``found`` lacks a column of ``wanted`` or has another type."""
    have = {f.name: f for f in found.fields}
    bad = [f"{f.name}: missing" if f.name not in have else f"{f.name}: {_bare(have[f.name].dataType)} instead of {_bare(f.dataType)}" for f in wanted.fields if f.name not in have or check_types and _bare(have[f.name].dataType) != _bare(f.dataType)]
    if bad:
        raise ValueError("the file doesn't fit the schema: " + "; ".join(bad) + f"\nfile: {_bare(found)}\nwanted: {_bare(wanted)}")


def strict_read(spark: SparkSession, paths: str | list[str], schema: Any, **options: Any) -> DataFrame:
    """Parquet with a schema that must be there: the footer's names and types are compared before anything is read."""
    wanted = as_schema(schema)
    found = spark.read.options(**options).parquet(*([paths] if isinstance(paths, str) else paths))
    check_columns(found.schema, wanted)
    return found.select(*[f"`{f.name}`" for f in wanted.fields]) if wanted.fields else found.select()
