"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from treeweave.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert len(mine)
    assert rows(mine, columns) == rows(theirs, columns)
