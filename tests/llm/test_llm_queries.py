"""Every query of the subpackage that has an equivalent agrees with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from termweave.llm import queries

TABLES = Path("/root/testdata/sf0.001")


def canonical(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in rows)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, str(TABLES))
    con = duckdb.connect()
    for table in TABLES.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    expected = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(tuple(r) for r in got.select(*columns).collect()) == canonical(expected.fetchall())
