"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import importlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


CORE = sorted(n for m in map(importlib.import_module, entry.MODULES) for n in m.ORACLES)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert got == Counter(tuple(map(norm, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['strataseek.llm'] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
