"""Every registered query with SQL equals that SQL run by another engine over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from barline.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if c == "date":
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    got, expected = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(con.execute(queries.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
