"""Every query with an oracle statement gives the same rows as DuckDB; without the llm subpackage the rest still works."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import rows  # noqa: E402

CORE = [k for c in entry.CATALOGS[:2] for k in c.queries]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cur.fetchall(), cols)


def test_entry(spark):
    assert entry.entry(spark).columns == ["item", "count"]


def test_nothing_in_the_core_imports_llm():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "tidemill").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemill.llm" not in p.read_text(), p


def test_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    import shutil

    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'p1_found' in e.queries(), 'p3_percentiles' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.split()[1:] == ["True", "False"], out.stderr
