"""Tables and queries of PostgreSQL (or any database with a JDBC driver on the class path)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.types import as_schema


def quoted(name: str) -> str:
    """An SQL identifier in double quotes."""
    if "\0" in name:
        raise ValueError("an identifier can't hold NUL")
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class PgTable:
    table: str
    schema: str | None = None

    def sql(self) -> str:
        return quoted(self.table) if self.schema is None else f"{quoted(self.schema)}.{quoted(self.table)}"


@dataclass(frozen=True)
class PgQuery:
    text: str

    def sql(self) -> str:
        return f"({self.text.rstrip().rstrip(';')}) AS q"


@dataclass(frozen=True)
class Connect:
    host: str
    database: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    port: int = 5432
    options: dict[str, str] = field(default_factory=dict)

    def url(self) -> str:
        extra = "&".join(f"{k}={v}" for k, v in sorted(self.options.items()))
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}" + (f"?{extra}" if extra else "")


def jdbc_options(connect: Connect, select: PgTable | PgQuery, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, fetch: int = 10_000) -> dict[str, str]:
    """The options of a JDBC read. With ``partition_column`` and its ``bounds`` it is read in parallel."""
    out = {"url": connect.url(), "dbtable": select.sql(), "driver": "org.postgresql.Driver", "fetchsize": str(fetch)}
    if connect.user is not None:
        out["user"] = connect.user
    if connect.password is not None:
        out["password"] = connect.password
    if partition_column is not None:
        if bounds is None:
            raise ValueError("partition_column needs bounds")
        out |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_postgres(spark: SparkSession, sources: Sequence[tuple[Connect, Sequence[PgTable | PgQuery]]], schema: Any = None, **how: Any) -> DataFrame:
    """The rows of every table and query of every connection, one after another; only the schema's columns are asked for.

    Filters, projections and limits reach the database. The driver's jar must be on the class path.
    """
    wanted, out = as_schema(schema), None
    for connect, selects in sources:
        for s in selects:
            df = spark.read.format("jdbc").options(**jdbc_options(connect, s, **how)).load()
            if wanted is not None:
                df = df.select(*[f"`{f.name}`" for f in wanted.fields])
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no source")
    return out


def write_postgres(df: DataFrame, connect: Connect, table: PgTable, mode: str = "append") -> None:
    o = jdbc_options(connect, table)
    df.write.format("jdbc").options(**o).mode(mode).save()
