"""Nearest vectors for tables of queries, against products of everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import vectors as V

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    x = (centres[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 16))).astype(np.float32)
    x[100:130] = x[100]  # a group of copies
    rows = [(i, [float(c) for c in v], 0, "z") for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [None] * 16), (9003, [float("nan")] * 16), (9004, [0.0] * 16), (9005, [1.0] * 15), (None, [1.0] * 16)]
    return x, spark.createDataFrame(rows + [(i, v, 0, "z") for i, v in odd], SCHEMA).repartition(5)


def brute(x, queries, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u[queries] @ u.T, 9)
    return [(q, int(i), r + 1) for q, row in zip(queries, s, strict=True) for r, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k])]


@pytest.mark.parametrize("size", [V.PASS, 7])
def test_exact(made, size):
    x, df = made
    queries = [*range(0, 1500, 50), 9000]
    got = sorted((r.query, r.key, r["rank"]) for r in V.nearest(df.filter(F.col("vec_id").isin(queries)), df, 10, queries_a_pass=size).collect())
    assert got == sorted(brute(x, queries[:-1], 10))


def test_nothing(made):
    _, df = made
    assert V.nearest(df.filter("false"), df, 5).count() == V.nearest(df.filter("vec_id = 1"), df.filter("false"), 5).count() == 0
    assert V.nearest(df.filter("vec_id > 9000"), df, 5).filter("query <> 9005").count() == 0


def test_lists(made, tmp_path):
    """Every vector is in one list, all lists together are exact, and some of them find 0.9 and more."""
    x, df = made
    lists = V.Lists.fit(df, 39)
    path = str(tmp_path / "lists")
    lists.write(df, path)
    kept = df.sparkSession.read.parquet(path)
    assert kept.count() == 1500 == kept.select("key").distinct().count() and kept.select("list").distinct().count() > 10
    queries = df.filter("vec_id % 50 = 0 AND vec_id < 1500")
    exact = V.nearest(queries, df, 10)
    same = lambda d: sorted((r.query, r.key, r["rank"]) for r in d.collect())
    assert same(lists.search(queries, kept, 10, probes=39)) == same(exact)
    told = V.recall(lists.search(queries, kept, 10), exact).first()
    assert told.queries == 30 and told.pairs == 300 and told.recall >= 0.9
    others = df.filter("vec_id % 50 = 1 AND vec_id < 1500")
    probes = lists.probes_for(others, kept, V.nearest(others, df, 10), 0.99)
    assert 1 <= probes < 39 and V.recall(lists.search(queries, kept, 10, probes=probes), exact).first().recall >= 0.9
    assert V.recall(exact.filter("false"), exact.filter("false")).first().recall is None
