"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams (of UTF-8 bytes of the lower-cased text, runs of white space as one space) are hashed into a
fixed number of features, present or absent. Document frequencies in the two classes of a bounded sample of labelled
documents give each feature its smoothed log-count ratio, and a logistic regression with an L2 penalty is fitted
on the ratios of those present. A feature is fitted if enough documents of the sample have it (half the root of the rarer
class's number, `support`) and it is TELLING times likelier in one class than in the other (as a logarithm), however many
there are: long texts bring very many n-grams that a few documents of one class have by chance, and with those the fit
learns the sample by heart. A score is one pass over the text with the weights as a vector of fixed length.

Defined results: null and empty texts get the score of a text without features; rows are scored each, also
if they repeat; labels with a null id, a null label or without a document are not learned from; with
labels of one class only every score is that class's share of the sample; an empty table gives no rows;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import crc_mod, keyed_join, materialise, text_of, unit_hash

#: Features by hashing; lengths of n-grams; fewest documents of any sample that must have a feature; least absolute ratio of one; pseudo-count of document frequencies.
FEATURE_BITS, ORDERS, LEAST, TELLING, PRIOR = 22, (5, 7, 9), 3, 1.5, 1.0
#: Most labelled documents of each class that are learned from (in expectation; drawn by a hash of the id), and passes of the fit.
SAMPLE, STEPS, PENALTY = 5000, 300, 2e-3
#: Documents of which more than one in HELD_OUT modulo are never learned from.
HELD_OUT = 5

_MUL, _FINAL = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def features(text: str) -> Iterator[np.ndarray]:
    """For each order the hashed n-grams of a text, with repetitions."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(data) < order:
            return
        h = h[: len(data) - order + 1] * _MUL + data[order - 1 :] + np.uint32(1)
        if order in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x *= _FINAL
            yield (x ^ (x >> np.uint32(13))) >> np.uint32(32 - FEATURE_BITS)


class _Present:
    """The distinct features of a text. Each occurrence writes its number into the feature's place, and the one that is found there counts."""

    def __init__(self) -> None:
        self.place = np.zeros(1 << FEATURE_BITS, np.int32)

    def of(self, text: str) -> np.ndarray:
        found = list(features(text))
        if not found:
            return np.empty(0, np.uint32)
        ids = np.concatenate(found)
        numbers = np.arange(len(ids), dtype=np.int32)
        self.place[ids] = numbers
        return ids[self.place[ids] == numbers]


def support(n: dict[int, int]) -> int:
    """How many documents of a sample, of so many in each class, must have a feature."""
    return max(LEAST, round(math.sqrt(min(n.values(), default=0)) / 2))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, present: np.ndarray) -> float:
        z = self.bias + float(self.weights[present].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    present, df = _Present(), np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            df[label, present.of(text)] += 1
    at = np.flatnonzero(df.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[0, at]), pa.array(df[1, at])], names=["feature", "n0", "n1"])


def _rows(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _Present()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [own[wanted[own]].astype(np.int32) for own in map(present.of, part.column(0).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["label", "ids"])

    return run


def fit(flat: np.ndarray, starts: np.ndarray, labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature (ratio times coefficient) and bias of the penalised logistic regression, by Nesterov's accelerated gradient.

    ``flat``: the features of all rows one after another, ``starts``: where each row's begin, and the end.
    """
    used, column = np.unique(flat, return_inverse=True)
    y, row = labels.astype(np.float64), np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(starts))
    value = ratios[flat].astype(np.float32)
    balance = np.where(y == 1, np.sqrt(max(1, (1 - y).sum()) / max(1, y.sum())), 1.0)
    balance /= balance.sum()
    squares = np.bincount(row, weights=value * value, minlength=len(y)) + 1
    step = 4 / np.percentile(squares, 95)
    coef, bias, ahead, ahead_bias = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for t in range(STEPS):
        z = np.bincount(row, weights=value * ahead[column], minlength=len(y)) + ahead_bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * balance
        new = ahead - step * (np.bincount(column, weights=value * g[row], minlength=len(used)) + PENALTY * ahead)
        new_bias, pull = ahead_bias - step * g.sum(), t / (t + 3)
        ahead, ahead_bias = new + pull * (new - coef), new_bias + pull * (new_bias - bias)
        coef, bias = new, new_bias
    weights = np.zeros(len(ratios))
    weights[used] = coef * ratios[used]
    return weights, float(bias)


def _sampled(labels: DataFrame, sample: int, held_out: int) -> tuple[DataFrame, float]:
    """(doc_id, label) of the labelled ids that may be learned from, of each class some ``sample`` drawn by a hash; and the share of label 1 among all of them."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(crc_mod("doc_id", held_out) != 0)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    return materialise(known.filter(unit_hash("doc_id", seed=6) < share).dropDuplicates(["doc_id"]), "drawn"), sizes.get(1, 0) / max(1, sum(sizes.values()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = HELD_OUT) -> Model:
    """Fit on at most some ``sample`` labelled documents of each class, whole texts, none with crc32(doc_id) divisible by ``held_out``."""
    known, prior = _sampled(labels, sample, held_out)
    seen = keyed_join(docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")), known, ["doc_id"], "inner").select("text", "label")  # 2 * sample rows in expectation
    size = 1 << FEATURE_BITS
    df = np.zeros((2, size), np.int64)
    n = {r.label: r.n for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = float(min(max(next(iter(n), 0), 1e-6), 1 - 1e-6))
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    counted = seen.mapInArrow(_count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(f"n0 + n1 >= {support(n)}")
    got = counted.toArrow()
    at = got.column("feature").to_numpy()
    df[0, at], df[1, at] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    ratios = np.log((df[1] + PRIOR) / (n[1] + 2 * PRIOR)) - np.log((df[0] + PRIOR) / (n[0] + 2 * PRIOR))
    ratios[(df.sum(axis=0) == 0) | (np.abs(ratios) < TELLING)] = 0
    rows = seen.mapInArrow(_rows(ratios != 0), "label int, ids array<int>").toArrow().combine_chunks()
    ids = rows.column("ids").combine_chunks()
    weights, bias = fit(ids.flatten().to_numpy(), ids.offsets.to_numpy(), rows.column("label").to_numpy(), ratios)
    share = min(max(prior, 1e-6), 0.5)
    bias = min(bias, float(np.log(share / (1 - share))))  # a text without evidence is no likelier toxic than any, and never called so
    return Model(weights.astype(np.float32), bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, present = shared.value, _Present()
        for batch in batches:
            scores = [model.score(present.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held: Column = crc_mod("doc_id", HELD_OUT) == 0
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with their columns; texts are scored where they are read and never shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    score = F.pandas_udf(_series_scorer(shared), "double")
    return docs.filter(score(text_of(docs)) < 0.5)


def _series_scorer(shared):
    import pandas as pd

    def score(texts: pd.Series) -> pd.Series:
        model, present = shared.value, _Present()
        return pd.Series([model.score(present.of(t)) for t in texts], dtype="float64")

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return score
