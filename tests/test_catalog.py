"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from caseloom.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df, columns):
    tidy = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(tidy(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_numbers_reach_the_greatest_label(spark):
    """The range is the table's own."""
    folder = SF.replace("sf0.01", "sf0.1")
    have = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in catalog.QUERIES["missing_numbers"](spark, folder).collect()]
    assert max(have) > 1500 and sorted(got) == [i for i in range(min(have), max(have) + 1) if i not in have]


def test_missing_numbers_start_at_zero_and_reach_1500(spark):
    """Also where the labels do not: the SQL's whole range."""
    have = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in catalog.QUERIES["missing_numbers"](spark, SF).collect()]
    assert max(have) < 1500 and sorted(got) == [i for i in range(1501) if i not in have]
