"""Nearest vectors for a table of queries: exactly, by blocks, or over inverted lists of a coarse quantiser.

Vectors stay where they lie. Queries are counted and go to the tasks as one matrix, or in passes of bounded size; a task
multiplies blocks of its vectors with them and keeps the best of each query, so what is moved is tasks x queries x k and
never a pair for each product. Scores are cosines, ties go to the smaller key.

Vectors that are null or empty, have null or non-finite entries, no length, or another length than the queries' (that of
most queries, of equally common ones the greatest) match nothing and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a pass (their matrix is broadcast: 32 MB at 64 entries), and products made at once.
PASS, PRODUCTS = 65_536, 4_000_000
#: Digits of a score that count; beyond them products differ by the order of their sums.
DIGITS = 12
#: Vectors on which lists are fitted, at most, and rounds of the fit.
FITTED, ROUNDS = 100_000, 20
#: Of the lists, the share that a query looks into unless it was measured how many it takes, and at least so many.
PROBED, LEAST_PROBED = 0.5, 4
#: What is asked of a measurement, so that other queries reach nine tenths, and the queries that it takes.
TARGET, MEASURED = 0.95, 1000


def usable(vectors: DataFrame, key: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """(key, v): vectors as doubles that have a direction."""
    v = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return v.filter(F.size("v") == dimensions) if dimensions is not None else v


def _unit(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class _Best:
    """The k best vectors of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.scores, self.keys = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of all ``keys`` for the queries ``rows``."""
        scores = np.round(scores, DIGITS)
        hopeful = (scores >= self.scores[rows, -1:]).any(axis=0)  # most vectors come too late for all queries
        if not hopeful.any():
            return
        scores, keys = scores[:, hopeful], keys[hopeful]
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.keys[rows], np.broadcast_to(keys, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.keys[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, place = np.nonzero(np.isfinite(self.scores))
        for begin in range(0, len(q), 50_000):
            some = slice(begin, begin + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[q[some]]), pa.array(self.keys[q[some], place[some]]), pa.array(self.scores[q[some], place[some]])], ["query", "key", "score"])


_FOUND = "query long, key long, score double"


def _nearest(shared, k: int):
    """For mapInArrow over (key, v), and list where queries look into lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, probes = shared.value
        best, every = _Best(len(names), k), np.arange(len(names))
        for batch in batches:
            unit, keys = _unit(batch, matrix.shape[1]), batch["key"].to_numpy()
            if probes is None:
                groups = [(every, np.arange(len(keys)))]
            else:
                of = batch["list"].to_numpy()
                groups = [(np.flatnonzero(probes[:, x]), np.flatnonzero(of == x)) for x in np.unique(of)]
            for rows, mine in groups:
                step = max(1, PRODUCTS // max(1, len(rows)))
                for begin in range(0, len(mine) if len(rows) else 0, step):
                    some = mine[begin : begin + step]
                    best.add(rows, matrix[rows] @ unit[some].T, keys[some])
        yield from best.batches(names)

    return run


def _passes(queries: DataFrame, key: str, vector: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable queries as (names, unit rows), at most ``size`` of them at a time."""
    q = usable(queries, key, vector)
    length = q.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return
    q, parts = q.filter(F.size("v") == length.d), -(-length.n // size)
    for part in range(parts):
        got = q.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow().combine_chunks()  # about a pass's number of rows
        if got.num_rows:
            batch = got.to_batches()[0]
            yield batch["key"].to_numpy(), _unit(batch, length.d)


def _merged(found: list[DataFrame], spark, k: int) -> DataFrame:
    all_of_them = found[0] if found else spark.createDataFrame([], _FOUND)
    for f in found[1:]:
        all_of_them = all_of_them.unionByName(f)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return all_of_them.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", queries_a_pass: int = PASS) -> DataFrame:
    """(query, key, score, rank): for every query the ``k`` nearest of all vectors, exactly."""
    spark, found = vectors.sparkSession, []
    for names, matrix in _passes(queries, key, vector, queries_a_pass):
        shared = spark.sparkContext.broadcast((names, matrix, None))
        found.append(usable(vectors, key, vector, matrix.shape[1]).mapInArrow(_nearest(shared, k), _FOUND))
    return _merged(found, spark, k)


class Lists:
    """Inverted lists: the centres of a coarse quantiser. Every vector belongs to the list of its nearest centre."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", dimensions: int | None = None, sample: int = FITTED, seed: int = 1) -> Lists:
        """Spherical k-means on a sample of at most about ``sample`` vectors (a documented bound: it decides how well lists part, never what they hold)."""
        v = usable(vectors, key, vector)
        lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        d = dimensions or (lengths.d if lengths else 1)
        drawn = v.filter(F.size("v") == d)
        if lengths and lengths.n > sample:
            drawn = drawn.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) < int(sample / lengths.n * (1 << 40)))
        model = KMeans(k=lists, distanceMeasure="cosine", maxIter=ROUNDS, seed=seed, featuresCol="f").fit(drawn.select(array_to_vector("v").alias("f")))
        return cls(np.array(model.clusterCenters()))

    def nearest_lists(self, unit: np.ndarray, n: int) -> np.ndarray:
        """Whether each row looks into each list: the ``n`` of the nearest centres."""
        scores = unit @ self.centres.T
        chosen = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        out = np.zeros(scores.shape, bool)
        np.put_along_axis(out, chosen, True, axis=1)
        return out

    def probes_for(self, queries: DataFrame, assigned: DataFrame, exact: DataFrame, target: float = TARGET, key: str = "vec_id", vector: str = "embedding", measured: int = MEASURED) -> int:
        """How many lists queries must look into to find the share ``target`` of their ``exact`` neighbours, measured on at most about ``measured`` of them (a documented bound)."""
        n = max(1, exact.select("query").distinct().count())
        drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(1 << 40)) < int(min(1.0, measured / n) * (1 << 40))
        where = exact.filter(drawn(F.col("query").cast("long"))).join(assigned.select("key", "list"), "key").groupBy("query", "list").agg(F.count("*").alias("n")).collect()  # a few lists to a query
        rank = {}
        for names, matrix in _passes(queries.filter(drawn(F.col(key).cast("long"))), key, vector, PASS):
            order = np.argsort(np.argsort(-(matrix @ self.centres.T), axis=1, kind="stable"), axis=1)
            rank |= {int(q): row for q, row in zip(names, order, strict=True)}
        hits = np.zeros(len(self.centres))
        for r in where:
            if r.query in rank:
                hits[rank[r.query][r.list]] += r.n
        return int(np.searchsorted(np.cumsum(hits), target * hits.sum())) + 1 if hits.any() else len(self.centres)

    def assign(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(key, v, list): every usable vector with its list."""
        shared, d = vectors.sparkSession.sparkContext.broadcast(self.centres), self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = np.argmax(np.round(_unit(batch, d) @ shared.value.T, DIGITS), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array(of)], ["key", "v", "list"])

        return usable(vectors, key, vector, d).mapInArrow(run, "key long, v array<double>, list int")

    def write(self, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
        """The lists as partitions of a table: a search for few lists reads only their files."""
        self.assign(vectors, key, vector).repartition("list", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("overwrite").partitionBy("list").parquet(path)

    def search(self, queries: DataFrame, assigned: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, queries_a_pass: int = PASS) -> DataFrame:
        """(query, key, score, rank): the ``k`` nearest among the lists that a query looks into. With as many probes as lists the result is exact."""
        spark, found = assigned.sparkSession, []
        n = len(self.centres)
        probes = min(n, probes if probes is not None else max(LEAST_PROBED, round(PROBED * n)))
        for names, matrix in _passes(queries, key, vector, queries_a_pass):
            if matrix.shape[1] != self.centres.shape[1]:
                continue
            looks = self.nearest_lists(matrix, probes)
            shared = spark.sparkContext.broadcast((names, matrix, looks))
            wanted = assigned.filter(F.col("list").isin(*[int(x) for x in np.flatnonzero(looks.any(axis=0))]))  # at most a hundred lists; prunes their partitions
            found.append(wanted.select("key", "v", "list").mapInArrow(_nearest(shared, k), _FOUND))
        return _merged(found, spark, k)



def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, pairs, found, recall) of a search against the exact result."""
    hit = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.when(F.col("pairs") > 0, F.col("found") / F.col("pairs")))
