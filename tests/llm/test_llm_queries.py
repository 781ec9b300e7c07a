from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import sys

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import rows  # noqa: E402
from tidemill.llm.queries import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got or name == "p5_restored"
        return
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cur.fetchall(), cols)
