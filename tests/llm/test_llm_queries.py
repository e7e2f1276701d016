"""The queries of the subpackage: against DuckDB where they have SQL, else that they run and keep their columns."""

from collections import Counter
from pathlib import Path

import pytest

from strataseek.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
COLUMNS = {
    "p3_found": ["chunk_id", "markup"], "p3_clean": ["chunk_id", "content", "kinds"], "p4_found": ["file_id"], "p4_labels": ["file_id", "label", "p_handwritten"], "p6_found": ["chunk_id", "line_no"],
    "p6_redacted": ["chunk_id", "content", "n_secrets"], "p10_found": ["doc_id"], "p7_found": ["chunk_id"], "p2_found": ["source_table", "record_id", "term"],
}


def norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = Q.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    want = con.sql(Q.ORACLES[name])
    assert sorted(want.columns) == cols
    assert Counter(tuple(map(norm, r)) for r in df.select(*cols).collect()) == Counter(tuple(map(norm, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = Q.QUERIES[name](spark, str(SF))
    assert df.columns == COLUMNS[name]
    rows = list(map(str, df.collect()))
    assert rows and len(rows) == len(set(rows))
