from pathlib import Path

import duckdb
import pandas as pd
import pytest

from outlinelake.plans.registry import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in SF.glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return db


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql_on_the_source(spark, duck, name):
    assert rows(QUERIES[name](spark, str(SF)).toPandas()) == rows(duck.sql(ORACLES[name]).df())
