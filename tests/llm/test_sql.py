"""The queries of this subpackage that have SQL, against DuckDB on the same files."""

import duckdb
import pytest

from plumbgrid.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = sorted(expected.fetchall())
    got = registry.queries()[name](spark, SF)
    assert set(got.columns) == set(columns)
    mine = sorted(map(tuple, got.select(columns).collect()))
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in mine] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in rows]
