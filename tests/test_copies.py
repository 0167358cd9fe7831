"""Queries on tables that are copies of the smallest scale with shifted keys, against their SQL twins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_catalogue import SF, cells
from weirflow.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Three times customers and events: keys and users differ, names and times don't."""
    to, c = tmp_path_factory.mktemp("copies"), duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (c_custkey + k * 15000 AS c_custkey) FROM '{SF}/customer.parquet', range(3) AS r(k)) TO '{to}/customer.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * REPLACE (event_id + k * 100000 AS event_id, user_id + k * 15000 AS user_id) FROM '{SF}/events.parquet', range(3) AS r(k) ORDER BY event_id) TO '{to}/events.parquet' (FORMAT parquet)")
    for t in ("customer", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet'")
    return str(to), c


@pytest.mark.parametrize("name", ["names_matched", "questions_answered"])
def test_same_as_sql(spark, copies, name):
    to, db = copies
    assert cells(catalogue.queries()[name](spark, to).toPandas()) == cells(db.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(f"{os.path.dirname(SF)}/sf0.1"), reason="needs the driver's tables")
def test_means_at_ties_whatever_the_order_of_files(spark, tmp_path):
    """Means that lie on a tie of the sixth digit are those of SQL that sums in the order of events, also where files hold them in none."""
    spark.read.parquet(f"{os.path.dirname(SF)}/sf0.1/events.parquet").repartition(5, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute("SET threads=1")
    db.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    got = catalogue.queries()["event_movements"](spark, str(tmp_path)).toPandas()
    assert len(got) > 4000 and cells(got) == cells(db.sql(catalogue.oracle_sql()["event_movements"]).df())
