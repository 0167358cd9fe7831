"""Every query against its SQL twin at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from weirflow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if hasattr(v, "__float__") else v
    return sorted(map(repr, [tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)]))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, db, name):
    assert cells(catalogue.queries()[name](spark, SF).toPandas()) == cells(db.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalogue.queries()["chunk_text"](spark, SF).count() > 0
