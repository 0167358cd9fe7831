"""Language identification by prediction by partial matching.

For each language the bytes of lower-cased sample texts give a context tree of orders 0 to ORDER; with the
statistics frozen, a byte costs its exact code length: if its longest context has seen it, by its count,
else an escape to the next shorter context, where bytes that were already offered are excluded, and at
last a uniform choice among the bytes left (escape method C). The language with the shortest code for the
whole text is predicted, and its share of the total likelihood is the score.

Each language has a tree of its own, of all contexts that its sample has twice or more. The code length of each
byte (of those the sample has, and of any other) after each context is tabulated once, so a byte costs a walk of at
most ORDER steps and a look-up. A worker remembers the code lengths of byte sequences it has met, in a table of fixed
size whose entries are checked, so most bytes of a corpus cost one look-up for all languages. Texts are read where
they lie. Trees are broadcast together as long as they are small; beyond a stated size they go in groups of languages,
one pass each, and the passes are joined by the digest of the text.

Defined results: a null text and one without a letter are `und` with score 0, as is every text if there is
nothing to learn from; equal code lengths go to the language that sorts first; rows that repeat are
predicted each; an empty table gives no rows; further columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import crc_mod, materialise, text_of, unit_hash

#: Longest context; labelled texts of each language that are learned from, in expectation; bytes of trees that are broadcast at once.
ORDER, SAMPLE, MODEL_BYTES = 4, 600, 256 << 20
#: Sequences whose code lengths a worker remembers, as a power of two.
MEMO_BITS = 20
#: Documents whose crc32(doc_id) has this remainder are never learned from.
MODULO, HELD_OUT = 4, 2

_LETTER = re.compile(r"[^\W\d_]")
_PAD = b" " * ORDER


def as_bytes(text: str) -> np.ndarray:
    """The bytes that are coded, after ORDER spaces as their first context."""
    return np.frombuffer(_PAD + text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """For each coded byte the number whose base-256 digits are its context and itself."""
    code = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | data[k : len(data) - ORDER + k]
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(grams(as_bytes(text)))
        for lang, found in by_lang.items():
            code, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


@dataclass(frozen=True)
class Tree:
    """The contexts of one language. Bytes that its sample has not are one column, the last."""

    column: np.ndarray  # [byte]
    step: np.ndarray  # [context, column of the byte before it]: the longer context, or the number of contexts where there is none
    bits: np.ndarray  # [context, column]

    def code_lengths(self, code: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram, after the longest context that the tree has of the others."""
        own, at = np.zeros(len(code), np.int32), np.zeros(len(code), np.int32)
        none = len(self.step) - 1
        for k in range(1, ORDER + 1):
            own = self.step[own, self.column[code >> 8 * k & 255]]
            at = np.where(own == none, at, own)
        return self.bits[at, self.column[code & 255]]

    @property
    def nbytes(self) -> int:
        return self.step.nbytes + self.bits.nbytes


class _Memo:
    """Code lengths of grams by language; a gram that meets another in its place takes the place."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.trees = list(trees.values())
        self.gram = np.full(1 << MEMO_BITS, -1, np.int64)
        self.bits = np.zeros((1 << MEMO_BITS, len(trees)), np.float32)

    def of(self, code: np.ndarray) -> np.ndarray:
        at = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
        out = self.bits[at]
        missed = np.flatnonzero(self.gram[at] != code)
        if len(missed):
            own = code[missed]
            found = np.stack([t.code_lengths(own) for t in self.trees], axis=1)
            out[missed] = found
            place = at[missed]
            # Of grams that want one place all writes are of the last, so a place never has one gram with another's bits.
            last = np.zeros(1 << MEMO_BITS, np.int32) if len(missed) > 1 << 16 else None
            if last is not None:
                last[place] = np.arange(len(missed))
                chosen = np.unique(last[place])
            else:
                _, back = np.unique(place[::-1], return_index=True)
                chosen = len(missed) - 1 - back
            self.gram[place[chosen]], self.bits[place[chosen]] = own[chosen], found[chosen]
        return out


class Model:
    """Trees by language. The memo is a worker's own and not part of what is sent."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.trees = {x: trees[x] for x in sorted(trees)}
        self.langs, self._memo = list(self.trees), None

    def __getstate__(self) -> dict:
        return {"trees": self.trees, "langs": self.langs, "_memo": None}

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.trees.values())

    def groups(self, most: int) -> list[Model]:
        """The trees in groups of together at most ``most`` bytes, or of one."""
        out: list[dict[str, Tree]] = [{}]
        for x, t in self.trees.items():
            if out[-1] and sum(o.nbytes for o in out[-1].values()) + t.nbytes > most:
                out.append({})
            out[-1][x] = t
        return [Model(g) for g in out]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits for the coded bytes, by language."""
        if self._memo is None:
            self._memo = _Memo(self.trees)
        total = np.zeros(len(self.langs))
        for a in range(0, len(data) - ORDER, 1 << 18):
            total += self._memo.of(grams(data[a : a + (1 << 18) + ORDER])).sum(axis=0, dtype=np.float64)
        return total

    def nats(self, text: str | None) -> np.ndarray | None:
        """Code lengths by language; null for a text without a letter."""
        if not text or not self.langs or not _LETTER.search(text):
            return None
        return self.code_lengths(as_bytes(text)) * np.log(2)

    def predict(self, text: str | None) -> tuple[str, float]:
        nats = self.nats(text)
        if nats is None:
            return "und", 0.0
        best = int(np.argmin(nats))
        return self.langs[best], float(1 / np.exp(nats[best] - nats).sum())


def tree(code: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of a language from its distinct grams and their counts: all contexts that occur twice or more."""
    letters = np.unique(code & 255)
    column = np.full(256, len(letters), np.int16)
    column[letters] = np.arange(len(letters))
    # A context's suffix occurs at least as often, so it is there too.
    contexts = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        distinct, back = np.unique(code >> 8 & ((1 << 8 * k) - 1), return_inverse=True)
        contexts.append(distinct[np.bincount(back, weights=n) > 1])
    first = np.cumsum([0, *map(len, contexts)])
    total = int(first[-1])
    step = np.full((total + 1, len(letters) + 1), total, np.int32)
    suffix = np.zeros((total, ORDER + 1), np.int32)  # the ids of a context's own suffixes, by length
    length = np.repeat(np.arange(ORDER + 1), [len(c) for c in contexts])
    counts = np.zeros((total, len(letters)), np.float64)
    for k, own in enumerate(contexts):
        ids = first[k] + np.arange(len(own))
        for j in range(1, k + 1):
            suffix[ids, j] = first[j] + np.searchsorted(contexts[j], own & ((1 << 8 * j) - 1))
        if k:
            step[suffix[ids, k - 1], column[own >> 8 * (k - 1)]] = ids
        if len(own):
            context = code >> 8 & ((1 << 8 * k) - 1)
            where = np.minimum(np.searchsorted(own, context), len(own) - 1)
            hit = own[where] == context
            np.add.at(counts, (first[k] + where[hit], column[code[hit] & 255]), n[hit])
    return Tree(column, step, _tabulate(counts, suffix, length))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from, by language, the distinct grams and their counts."""
    return Model({x: tree(*counts[x]) for x in counts})


def _tabulate(counts: np.ndarray, suffix: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Code lengths [context, column] with escapes and exclusions; the last column is any byte that the sample has not."""
    letters = counts.shape[1]
    out = np.empty((len(counts), letters + 1), np.float32)
    for k in range(ORDER + 1):
        for rows in np.array_split(np.flatnonzero(length == k), 1 + int((length == k).sum()) // 8192):
            cost, spent = np.zeros((len(rows), letters)), np.zeros((len(rows), 1))
            offered = np.zeros((len(rows), letters), np.bool_)
            for j in range(k, -1, -1):
                c = np.where(offered, 0, counts[suffix[rows, j]])
                n, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                some = np.maximum(n + kinds, 1)
                cost = np.where(c > 0, spent - np.log2(np.maximum(c, 1) / some), cost)
                spent = np.where(n > 0, spent - np.log2(np.maximum(kinds, 1) / some), spent)  # where all its bytes are excluded a context costs nothing
                offered |= c > 0
            left = np.maximum(256 - offered.sum(axis=1, keepdims=True), 1)
            out[rows, :letters] = np.where(offered, cost, spent + np.log2(left))
            out[rows, letters:] = spent + np.log2(left)
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from whole texts of some ``sample`` documents of each language, drawn by a hash of the id; never from held-out ones."""
    known = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text"), F.col("lang").cast("string")).filter("lang IS NOT NULL")
    known = known.filter(crc_mod("doc_id", MODULO) != HELD_OUT)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build({})
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample / n)]), F.col("lang"))
    drawn = known.filter(unit_hash("doc_id", seed=2) < share).select("lang", "text")
    got = drawn.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    code, n, lang = got.column("code").to_numpy(), got.column("n").to_numpy(), np.array(got.column("lang").to_pylist(), object)
    return build({x: (code[lang == x], n[lang == x]) for x in sorted(set(lang.tolist()))})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _measure(shared):
    """For each text the best language of a group, its code length, and minus the log of the group's whole likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, langs, least, whole = [], [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (nats := shared.value.nats(text)) is not None:
                    best = int(np.argmin(nats))
                    sha.append(digest)
                    langs.append(shared.value.langs[best])
                    least.append(float(nats[best]))
                    whole.append(float(nats[best] - np.log(np.exp(nats[best] - nats).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(langs, pa.string()), pa.array(least, pa.float64()), pa.array(whole, pa.float64())], names=["sha", "lang", "nats", "whole"])

    return run


def identify(docs: DataFrame, model: Model | None = None, most: int = MODEL_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Trees of more than ``most`` bytes go in several passes."""
    model, spark = model or train(docs), docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", MODULO) == HELD_OUT).alias("held_out"), text.alias("text"))
    if model.nbytes <= most:
        return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
    sha, found = F.sha2("text", 256).alias("sha"), None
    for group in model.groups(most):
        shared = spark.sparkContext.broadcast(group)
        part = materialise(rows.select(sha, "text").mapInArrow(_measure(shared), "sha string, lang string, nats double, whole double").dropDuplicates(["sha"]), "group")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("sha").agg(F.min_by("lang", F.struct("nats", "lang")).alias("lang"), F.min("nats").alias("nats"), F.collect_list("whole").alias("whole"))  # one for each group
    score = 1 / F.aggregate("whole", F.lit(0.0), lambda s, w: s + F.exp(F.col("nats") - w))
    best = materialise(best.select("sha", "lang", score.alias("p")), "best")
    out = rows.select("doc_id", "held_out", sha).join(best, "sha", "left")
    return out.select("doc_id", "held_out", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce("p", F.lit(0.0)).alias("score"))
