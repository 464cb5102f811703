"""Every query that has SQL, against DuckDB on the same files."""

import duckdb
import pandas as pd
import pytest

from plumbgrid.plans.queries import ORACLES, QUERIES
from plumbgrid.plans.relations import TABLES, relation

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, duck, name):
    got, expected = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLES[name]).df())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1]) and len(got[1]) > 0
    assert got[1] == expected[1]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["erosion_page", "thermal_page", "ridge_page", "drainage_page", "wrapped_blur", "periodicity", "chain_page"])
def test_every_frame_has_its_page(spark, sf, name):
    frames = {r.frame for r in relation(spark, sf, "cameras").collect()}
    got = QUERIES[name](spark, sf)
    pages = got.selectExpr("CAST(page_x / 64 AS BIGINT) AS page") if name == "chain_page" else got.select("page")
    assert len(frames) > 8 and {r.page for r in pages.distinct().collect()} == frames
