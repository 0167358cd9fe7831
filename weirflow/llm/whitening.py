"""Embedding whitening by Spark MLlib: computeSVD on centred distributed rows.

Entries become integers x = floor(1024 * c) + 100000, so that counts, sums and deviations are exact. A first pass
takes n and the sum of every dimension, and their least and greatest entries. Rows less their means go to
``RowMatrix.computeSVD``; the squares of its singular values over n are the eigenvalues of the covariance with divisor n
(not n - 1), its right vectors the components. The total variance is no by-product of the decomposition: it is the
exact sum of all deviations (n * x - S) ** 2, over n ** 3. Rows are then projected and scaled, and the covariance of what
comes out is measured in two more passes (means first, then centred products).

A row's work needs that row and a matrix of dimensions x components, so nothing is shuffled but sums; no group exists that
could be hot. Up to 15,000 dimensions the decomposition is MLlib's local one of the distributed Gramian (dimensions squared,
8 bytes each, at the driver); beyond, its iterative one.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped; of vectors of different
lengths those of the commonest length stay (of equally common ones the greatest); rows that repeat count each, whatever
their ids; components whose singular value is at most 1e-5 of the greatest (the Gramian's rounding shows in the covariance of
those) are left out, so equal vectors, or one alone, give no rows; no rows give no rows; a deviation that no long holds is null, and `deviation_exact` has it as
a decimal of 38 digits where that holds it; entries beyond 2**52 count as that; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import materialise

#: Steps of the grid and its zero, so that usual entries are positive.
STEPS, ZERO = 1024, 100_000
#: Components returned.
COMPONENTS = 8
#: Singular values count from this share of the greatest on.
LEAST = 1e-5
#: Up to so many dimensions MLlib decomposes the Gramian as a whole if more than half of the components are asked for.
WHOLE = 15_000
_MOST = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into its whitened form, and what is known about the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components, unit columns
    eigenvalues: np.ndarray
    variance: float  # the trace of the covariance


def gridded(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as arrays of longs."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.filter("c is not null and size(c) > 0 and forall(c, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    grid = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * float(STEPS), F.lit(float(_MOST))), F.lit(-float(_MOST)))) + ZERO)
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return materialise((rows.filter(F.size("c") == best.d) if best else rows).select("vec_id", grid.cast("array<long>").alias("x")), "grid")


def _deviation(n: int, sums: list[int], spread: int) -> str:
    """SQL for the exact deviation of x as a decimal: in longs where the spread of entries proves that they hold it."""
    if n * spread < 2**31 and len(sums) * (n * spread) ** 2 < 2**63:
        each = f"zip_with(x, array({', '.join(f'{s}L' for s in sums)}), (e, s) -> {n}L * e - s)"
        return f"cast(aggregate({each}, 0L, (t, d) -> t + d * d) as decimal(38,0))"
    each = f"zip_with(x, array({', '.join(f'cast({s}BD as decimal(38,0))' for s in sums)}), (e, s) -> try_subtract(cast(cast(e as decimal(19,0)) * cast({n}BD as decimal(18,0)) as decimal(38,0)), s))"
    return f"aggregate({each}, cast(0 as decimal(38,0)), (t, d) -> try_cast(try_add(t, try_cast(try_multiply(d, d) as decimal(38,0))) as decimal(38,0)))"


def fit(grid: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of all rows of ``gridded``, and the rows with their deviations."""
    per = grid.select(F.posexplode("x").alias("at", "e")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("decimal(28,0)")).alias("s"), F.min("e").alias("low"), F.max("e").alias("high")).orderBy("at").collect()  # a row for each dimension
    if not per:
        return None, grid.withColumn("deviation_exact", F.lit(None).cast("decimal(38,0)"))
    n, sums = per[0].n, [int(r.s) for r in per]
    rows = grid.withColumn("deviation_exact", F.expr(_deviation(n, sums, max(r.high - r.low for r in per))))
    means = np.array([s / n for s in sums])
    centred = F.expr(f"zip_with(x, array({', '.join(f'{m!r}D' for m in means.tolist())}), (e, m) -> cast(e as double) - m)")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(grid.select(array_to_vector(centred).alias("v")), "v"), n, len(sums))
    wanted = len(sums) // 2 + 1 if len(sums) <= WHOLE else components
    svd = matrix.computeSVD(max(wanted, min(components, len(sums))), computeU=False, rCond=LEAST) if any(r.high > r.low for r in per) else None
    sigma = np.array(svd.s.toArray()[:components]) if svd else np.empty(0)
    vectors = svd.V.toArray()[:, : len(sigma)] if svd else np.empty((len(sums), 0))
    total = rows.agg(F.sum(F.col("deviation_exact").cast("double")).alias("about"), F.sum("deviation_exact").alias("t"), F.count("deviation_exact").alias("k")).first()
    variance = float(total.t) / n**3 if total.k == n and total.t is not None else float(np.square(svd.s.toArray()).sum() / n if svd else 0)
    return Whitening(n, sums, vectors, sigma**2 / n, variance), rows


def _project(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = shared.value
        n, d, k = w.n, len(w.sums), len(w.eigenvalues)
        means, scaled = np.array([s / n for s in w.sums]), w.components / np.sqrt(w.eigenvalues)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
            values = pa.array(((x - means) @ scaled).ravel())
            offsets = pa.array(np.arange(0, k * len(x) + 1, max(k, 1), dtype=np.int32)[: len(x) + 1] if k else np.zeros(len(x) + 1, np.int32))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["deviation_exact"], pa.ListArray.from_arrays(offsets, values)], ["vec_id", "deviation_exact", "w"])

    return run


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of w (divisor n, centred before multiplying) minus the identity."""
    if not k:
        return 0.0
    means = whitened.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    cov = whitened.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact."""
    grid = gridded(vectors)
    model, rows = fit(grid, components)
    schema = "vec_id long, deviation_exact decimal(38,0), w array<double>"
    if model is None:
        wide, error, share, n = rows.selectExpr("vec_id", "deviation_exact", "cast(array() as array<double>) as w"), 0.0, [], 0
    else:
        shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions x components
        wide = materialise(rows.mapInArrow(_project(shared), schema), "whitened")
        error, share, n = identity_error(wide, len(model.eigenvalues)), (model.eigenvalues / model.variance).tolist() if model.variance else [], model.n
    explained = F.element_at(F.array(*[F.lit(x) for x in share or [0.0]]), F.col("at") + 1)
    each = wide.select("vec_id", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as bigint)").alias("deviation"), "whitened",
        explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
