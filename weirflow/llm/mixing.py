"""Mixing documents to target weights of soft domains, with DataFrame functions only.

Domains come from a table of labels: good (of quality, not toxic), poor (not of quality) and toxic. A naive
Bayes classifier on binned features of the text, trained on a bounded sample of labelled documents, gives
each document a posterior over domains. The features are its surface (symbols, capitals, digits, word length,
repetition, length) and its vocabulary: how many distinct words it has of those that tell the poor or the
toxic documents of the sample from the others, by a likelihood-ratio test on document frequencies. Its rate,
how often it is to be seen, is nonnegative and solves a least-squares problem: the rates stay as close to
one as they can while the expected tokens of each domain, summed over all documents, meet the target. The
optimum is one plus a force for each domain, weighted by the posterior and projected on the bounds; damped
Newton steps find the three forces. Posteriors depend on the bins alone, so all documents of a cell of bins
share their rate: the steps run as aggregations over the cells, whose number is bounded by the bins, not by
the corpus. `mixed`, which must lose no document, has rates of one at least and lets the mix grow instead.

Defined results: null and empty texts have no tokens and fall into the cell of empty texts; rows that
repeat have equal rates; labels with a null id, without a document or without values are not learned
from; without labels all posteriors are equal and all rates one; an empty table gives no rows; further
columns of the input stay as they are in `mixed` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import keyed_join, let, materialise, text_of, unit_hash, whole_row

DOMAINS = ("good", "poor", "toxic")
#: Target share of each domain in the tokens; least and greatest rate; tokens of the mix, in sizes of the corpus: as rates go down to zero, totals meet the targets without growth.
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}
LEAST, MOST, GROWTH = 0.0, 3.0, 1.0
#: The same where no document may be lost: least rate, and most tokens of the mix.
KEEP_LEAST, KEEP_GROWTH = 1.0, 1.3
#: Labelled documents that are learned from (in expectation, drawn by a hash of the id); weight of the distance from one.
SAMPLE, PULL = 20_000, 5e-4
#: Evaluations at most; error of the totals, in sizes of the corpus, at which they end.
STEPS, CLOSE = 80, 1e-7

#: Lower edges of the bins of each feature.
EDGES = {
    "symbols": (0.01, 0.03, 0.06, 0.12, 0.25), "capitals": (0.005, 0.02, 0.05, 0.2, 0.5), "digits": (0.001, 0.01, 0.05, 0.2),
    "word_length": (2.5, 4.0, 5.0, 6.0, 8.0, 12.0), "repetition": (0.1, 0.25, 0.5, 0.75, 0.9), "log_tokens": (1.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0),
    "poor_words": (1.0, 2.0, 3.0, 5.0, 9.0), "toxic_words": (1.0, 2.0, 3.0, 5.0, 9.0),
}
#: Words of each of these two domains that are counted at most, and the least likelihood-ratio statistic of one.
WORDS, STRONG = 64, 15.0
#: What words are trimmed of.
_MARKS = ".,;:!?\"'()"
_CELL, _TOKENS = "_wf_cell", "_wf_tokens"
_BASE = 16


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _plain(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(_MARKS))


def _drawn(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the sample of labels that is learned from."""
    known = labels.select(F.col("doc_id").cast("long"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    n = known.count()
    return materialise(known.filter(unit_hash("doc_id", seed=9) < SAMPLE / max(1, n)).dropDuplicates(["doc_id"]), "drawn")


def telling_words(docs: DataFrame, labels: DataFrame) -> list[list[str]]:
    """For each domain but the first, the words that most tell its labelled documents from those of the others."""
    seen = keyed_join(docs, _drawn(labels), ["doc_id"], "inner").select("domain", F.array_distinct(F.transform(_words(text_of(docs)), _plain)).alias("words"))
    seen = materialise(seen, "seen")
    sizes = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    whole = float(sum(sizes.values()))
    found = seen.select("domain", F.explode("words").alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").cast("double").alias("all"), *[F.count_if(F.col("domain") == d).cast("double").alias(f"n_{d}") for d in range(1, len(DOMAINS))])
    found = materialise(found.filter("all > 1"), "words")

    def part(have: Column, a: Column, b: float) -> Column:
        return F.when(have > 0, 2 * have * (F.log(have) - F.log(a * b / whole))).otherwise(0.0)

    out = []
    for d in range(1, len(DOMAINS)):
        n = float(sizes.get(d, 0))
        if not 0 < n < whole:
            out.append([])
            continue
        x, t = F.col(f"n_{d}"), F.col("all")
        strength = part(x, t, n) + part(n - x, whole - t, n) + part(t - x, t, whole - n) + part(whole - t - n + x, whole - t, whole - n)
        best = found.filter(x * whole > t * n).select("word", strength.alias("g")).filter(F.col("g") > STRONG).orderBy(F.desc("g"), "word").limit(WORDS).collect()
        out.append([r.word for r in best])
    return out


def described(docs: DataFrame, telling: list[list[str]]) -> DataFrame:
    """The rows with the number of their tokens (words) and their cell, the bins of all features as one number."""
    text = text_of(docs)
    every = sorted({w for words in telling for w in words})

    def count(hits: Column, own: list[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(own))) if own else F.lit(0)

    def vocabulary(kinds: Column) -> Column:
        hits = F.array_distinct(F.transform(F.filter(kinds, lambda w: _plain(w).isin(every)), _plain)) if every else F.array().cast("array<string>")
        return let(hits, lambda h: F.struct(F.size(kinds).alias("kinds"), *[count(h, own).alias(f"{d}_words") for d, own in zip(DOMAINS[1:], telling, strict=True)]))

    counted = docs.withColumn("_wf_s", F.struct(
        F.length(text).alias("n"), _without(text, "!\"#$%&*+/<=>?@[\\]^_`{|}~").alias("symbols"), _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
        _without(text, "0123456789").alias("digits"), let(_words(text), lambda w: F.struct(F.size(w).alias("all"), let(F.array_distinct(w), vocabulary).alias("of"))).alias("words"),
    ))
    n, t = F.greatest(F.col("_wf_s.n"), F.lit(1)), F.col("_wf_s.words.all")
    values = {
        "symbols": F.col("_wf_s.symbols") / n, "capitals": F.col("_wf_s.capitals") / n, "digits": F.col("_wf_s.digits") / n,
        "word_length": F.col("_wf_s.n") / F.greatest(t, F.lit(1)), "repetition": 1 - F.col("_wf_s.words.of.kinds") / F.greatest(t, F.lit(1)), "log_tokens": F.log1p(t.cast("double")),
        **{f"{d}_words": F.col(f"_wf_s.words.of.{d}_words") for d in DOMAINS[1:]},
    }
    cell = F.lit(0).cast("long")
    for name, edges in EDGES.items():
        at = sum(((values[name] >= e).cast("int") for e in edges), F.lit(0))
        cell = cell * _BASE + at
    return counted.withColumn(_CELL, cell).withColumn(_TOKENS, t.cast("long")).drop("_wf_s")


def _bin(place: int) -> Column:
    return F.shiftright(F.col(_CELL), 4 * (len(EDGES) - 1 - place)).bitwiseAND(F.lit(_BASE - 1)).cast("int")


def _posteriors(cells: DataFrame, made: DataFrame, labels: DataFrame) -> DataFrame:
    """The cells with p_<domain>: naive Bayes with add-one smoothing from a sample of labelled documents in ``made``."""
    seen = keyed_join(made, _drawn(labels), ["doc_id"], "inner").groupBy(_CELL, "domain").agg(F.count("*").alias("n")).collect()  # at most cells * domains rows
    totals = [1.0 + sum(r.n for r in seen if r.domain == d) for d in range(len(DOMAINS))]
    score = [F.lit(math.log(x / sum(totals))) for x in totals]
    for place, edges in enumerate(EDGES.values()):
        for d in range(len(DOMAINS)):
            counts = [1.0] * (len(edges) + 1)
            for r in seen:
                if r.domain == d:
                    counts[(r[_CELL] >> 4 * (len(EDGES) - 1 - place)) & (_BASE - 1)] += r.n
            total = sum(counts)
            score[d] = score[d] + F.element_at(F.array(*[F.lit(math.log(c / total)) for c in counts]), _bin(place) + 1)
    if not seen:
        score = [F.lit(0.0) for _ in DOMAINS]
    cells = cells.select("*", *[s.alias(f"s_{d}") for s, d in zip(score, DOMAINS, strict=True)])
    top = F.greatest(*[F.col(f"s_{d}") for d in DOMAINS])
    parts = [F.exp(F.col(f"s_{d}") - top) for d in DOMAINS]
    whole = sum(parts[1:], parts[0])
    return cells.select(_CELL, "tokens", "docs", *[(p / whole).alias(f"p_{d}") for p, d in zip(parts, DOMAINS, strict=True)])


def _solved(h: list[list[float]], g: list[float]) -> list[float]:
    """x of h x = g for a small positive definite h."""
    rows = [[*r, v] for r, v in zip(h, g, strict=True)]
    for i in range(len(rows)):
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i:
                rows[j] = [a - rows[j][i] * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[-1] for r in rows]


def _forces(cells: DataFrame, whole: float, goal: list[float], rate_of: Callable[[list[float]], tuple[Column, Column]], least: float) -> list[float]:
    """The force of each domain at the optimum: the minimum of the convex dual, by Newton steps of bounded length that are halved until they descend."""
    n, share = len(DOMAINS), F.col("tokens") / whole
    p = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def at(x: list[float]) -> tuple[float, list[float], list[list[float]]]:
        z, rate = rate_of(x)
        free = share * ((rate > least) & (rate < MOST)).cast("double")
        sums = cells.agg(F.sum(share * (z * rate - (rate - 1) * (rate - 1) / 2)), *[F.sum(share * rate * q) for q in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        sums = [float(v or 0.0) for v in sums]
        value = sums[0] + sum(PULL * v * v / 2 - g * v for v, g in zip(x, goal, strict=True))
        slope = [PULL * v + s - g for v, s, g in zip(x, sums[1:], goal, strict=False)]
        bend = [[PULL * (i == j) for j in range(n)] for i in range(n)]
        for (i, j), v in zip(pairs, sums[1 + n :], strict=True):
            bend[i][j] += v
            bend[j][i] = bend[i][j]
        return value, slope, bend

    x, step = [0.0] * n, [0.0] * n
    value, slope, bend = at(x)
    for _ in range(STEPS):
        if max(map(abs, slope)) < CLOSE:
            break
        if not any(step):
            step = [-v for v in _solved(bend, slope)]
            long = max(map(abs, step)) / (2 * max(1.0, *map(abs, x)))
            step = [v / max(1.0, long) for v in step]
        tried = [a + b for a, b in zip(x, step, strict=True)]
        found = at(tried)
        if found[0] <= value + 1e-4 * sum(a * b for a, b in zip(slope, step, strict=True)) + 1e-13:
            x, (value, slope, bend), step = tried, found, [0.0] * n
        else:
            step = [v / 2 for v in step]
    return x


def cell_rates(made: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = LEAST, growth: float = GROWTH) -> DataFrame:
    """(cell, p_<domain>, rate) from the described documents."""
    cells = made.groupBy(_CELL).agg(F.sum(_TOKENS).alias("tokens"), F.count("*").alias("docs"))
    cells = materialise(_posteriors(cells, made, labels), "cells")
    p = [F.col(f"p_{d}") for d in DOMAINS]
    first = cells.agg(*[F.sum(F.col("tokens") * x) for x in p]).first()
    natural = [float(x or 0.0) for x in first]
    whole = sum(natural) or 1.0
    wanted = [targets[d] / sum(targets.values()) for d in DOMAINS]
    budget = min(growth, max(a / whole / w for a, w in zip(natural, wanted, strict=True) if w > 0))  # beyond it the domain there is most of needs no cut
    learned = max(abs(a / whole - 1 / len(DOMAINS)) for a in natural) > 1e-9

    def rate_of(forces: list[float]) -> tuple[Column, Column]:
        z = sum((x * v for x, v in zip(p, forces, strict=True)), F.lit(0.0))
        return z, F.least(F.greatest(1 + z, F.lit(least)), F.lit(MOST))

    forces = _forces(cells, whole, [w * budget for w in wanted], rate_of, least) if learned else [0.0] * len(DOMAINS)
    return materialise(cells.select(_CELL, *[f"p_{d}" for d in DOMAINS], rate_of(forces)[1].alias("rate")), "rates")


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row per document: doc_id, tokens, p_good, p_poor, p_toxic, rate."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = materialise(described(d, telling_words(d, labels)).select("doc_id", _TOKENS, _CELL), "described")
    rates = cell_rates(made, labels, targets)
    return keyed_join(made, rates, [_CELL], "left").select("doc_id", F.col(_TOKENS).alias("tokens"), *[f"p_{x}" for x in DOMAINS], "rate")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as its rate says: the whole part of the rate for sure, once more with the rest as probability, by a hash of the id.

    Texts are described once and written with their cell, so no second pass reads their words.
    """
    d = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    telling = telling_words(d, labels)
    made = materialise(described(d, telling).select("_wf_row", "doc_id", _TOKENS, _CELL), "described")
    rates = cell_rates(made.select("doc_id", _TOKENS, _CELL), labels, targets, KEEP_LEAST, KEEP_GROWTH).select(_CELL, F.col("rate").alias("_wf_rate"))
    times = F.floor("_wf_rate") + (unit_hash("doc_id", seed=99) < F.col("_wf_rate") - F.floor("_wf_rate")).cast("int")
    repeated = keyed_join(made, rates, [_CELL], "left").withColumn("_wf_times", times).filter("_wf_times > 0")
    return repeated.withColumn("_wf_copy", F.explode(F.sequence(F.lit(1), F.col("_wf_times").cast("int")))).select("_wf_row.*")
