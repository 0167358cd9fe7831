"""Phrase collocation mining by suffix-sigma: frequent phrases of a language and how tightly their words stick together.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words. A first
pass counts words for each language. The second takes, at every word, the suffix that starts there, truncated
to MOST words, to the end of its piece and before the first word that is too rare to stand in a phrase (a
phrase is no more frequent than its rarest word, so nothing is lost). Equal suffixes are counted where they
arise, then shuffled by language and first words (a word's number says its language), sorted, and read once
with a stack that holds the prefixes of the suffix at hand: a prefix that goes off the stack has its whole
count. Phrases, their parts and their counts are joined afterwards.

A partition is a range of suffixes, with bounds drawn from a sample of texts, so a frequent first word or pair
of words is spread over as many partitions as it fills; bounds decide about balance alone. A prefix on the
first or the last suffix of a batch may go on in the next one: its counts are summed afterwards. A suffix
that millions of texts share is one row for each task that met it. Frequent words are broadcast as a list, so
that suffixes are a few bytes, up to a counted number of them. Beyond it suffixes are spelt out and frequent
words are told by a bitmap of a fixed greatest size: a frequent word is always seen as such, and a rare one that is
taken for frequent costs rows and changes no result.

Defined results: null text counts as empty and has no words; null lang is ``und``, together with texts that
say so; rows that repeat count each; words may be of any length; an empty table gives no rows; further columns
of the input are ignored, whatever their names. Scores are exact for up to 10**17 words a language.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import keyed_join, materialise, text_of

#: Words of a phrase.
LEAST, MOST = 2, 5
#: Tokens (words and breaks) whose suffixes are counted together in a task, and rows of an Arrow batch.
PORTION, BATCH = 1_500_000, 100_000
#: Frequent words, over all languages, that are broadcast as a list.
LISTED = 500_000
#: Words for each partition of the shuffle, and of how many suffixes bounds are drawn: for each bound, and for all.
PER_PARTITION, PER_BOUND, SAMPLE = 2_000_000, 1000, 1_000_000
#: Bits of the bitmap of frequent words: so many for each, a power of two between these powers. The greatest takes 64 MB.
BITS_PER_WORD, FEWEST_BITS, MOST_BITS = 16, 16, 29
#: Distinct words that a task counts before it lets them go.
COUNTED = 500_000
#: Buckets of a language in which phrases are ranked before they meet.
SALTS = 32

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_SEED = 42


def tokens(text: str) -> list[bytes]:
    """The words of a text in order, with a break wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))


# -- words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and with a null word the number of all words."""
    held: dict[str, Counter] = {}

    def let_go() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            words = [*(w.decode("utf-8", "surrogatepass") for w in counts), None]
            columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([*counts.values(), sum(counts.values())], pa.int64())]
            yield from pa.table(columns, ["lang", "word", "n"]).to_batches(BATCH)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(tokens(text))
        if sum(map(len, held.values())) > COUNTED:
            yield from let_go()
    yield from let_go()


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of words that occur ``least`` times in their language, and with a null word the number of all words of the language."""
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return materialise(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")


class Listed:
    """Frequent words by number: a suffix is the numbers of its words, of as many bytes each as the numbers take. At most LISTED words."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.names = words
        self.width = max(1, (len(words).bit_length() + 7) // 8)
        self.bits = max(1, len(words).bit_length())
        self.number: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(words):
            self.number.setdefault(lang, {})[word.encode("utf-8", "surrogatepass")] = i

    def ids(self, lang: str) -> dict[bytes, int]:
        return _Known(self.number.get(lang, {}))

    def keys(self, rows: np.ndarray, ids: dict[bytes, int]) -> pa.Array:
        raw = rows.astype(">u4").view(np.uint8).reshape(*rows.shape, 4)[:, :, 4 - self.width :]
        there = rows >= 0
        ends = np.cumsum(there.sum(axis=1)) * self.width
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[there]))])

    def read(self, suffixes: pa.Array) -> tuple[np.ndarray, list[tuple[str, str]]]:
        """The numbers of the words, -1 where a suffix has ended, and the names of the numbers."""
        offsets = np.frombuffer(suffixes.buffers()[1], np.int32, len(suffixes) + 1, suffixes.offset * 4)
        raw = np.frombuffer(suffixes.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets) // self.width
        rows = np.full((len(suffixes), MOST), -1, np.int32)
        for k in range(MOST):
            there = size > k
            rows[there, k] = 0
            for j in range(self.width):
                rows[there, k] = rows[there, k] << 8 | raw[offsets[:-1][there] + k * self.width + j]
        return rows, self.names


class Flagged:
    """Any number of frequent words by a bitmap of their hashes, at most 64 MB: a suffix is spelt out, its language first, a blank behind each."""

    def __init__(self, power: int, flags: bytes) -> None:
        self.mask, self.flags = (1 << power) - 1, flags
        self.bits = PORTION.bit_length()

    def __contains__(self, at: int) -> bool:
        return bool(self.flags[(at & self.mask) >> 3] >> (at & 7) & 1)

    def ids(self, lang: str) -> dict[bytes, int]:
        return _Met(lang, self)

    def keys(self, rows: np.ndarray, ids: dict[bytes, int]) -> pa.Array:
        words = pa.array([*(w + b" " for w in ids.words), b""], pa.binary())
        columns = [words.take(pa.array(np.where(c < 0, len(ids.words), c))) for c in rows.T]
        return pc.binary_join_element_wise(pa.scalar(ids.lang.hex().encode() + b" ", pa.binary()), *columns, pa.scalar(b"", pa.binary()))

    def read(self, suffixes: pa.Array) -> tuple[np.ndarray, list[tuple[str, str]]]:
        rows, number = np.full((len(suffixes), MOST), -1, np.int32), {}
        for i, suffix in enumerate(suffixes.to_pylist()):
            lang, *words, _ = suffix.split(b" ")
            rows[i, : len(words)] = [number.setdefault((lang, w), len(number)) for w in words]
        return rows, [(bytes.fromhex(lang.decode()).decode("utf-8", "surrogatepass"), w.decode("utf-8", "surrogatepass")) for lang, w in number]


class _Known(dict):
    """Numbers of listed words; -1 for all others and for breaks."""

    def __missing__(self, word: bytes) -> int:
        return -1


class _Met(dict):
    """Numbers of a language's flagged words in the order they are met; -1 for all other words and for breaks."""

    def __init__(self, lang: str, known: Flagged) -> None:
        self.lang, self.known, self.words = lang.encode("utf-8", "surrogatepass"), known, []
        self.seed = xxhash.xxh64_intdigest(self.lang, _SEED)
        self[_BREAK] = -1

    def __missing__(self, word: bytes) -> int:
        n = -1
        if xxhash.xxh64_intdigest(word, self.seed) in self.known:
            n = len(self.words)
            self.words.append(word)
        self[word] = n
        return n


def lexicon(words: DataFrame, listed: int = LISTED) -> Listed | Flagged:
    """The frequent words in a form of bounded size: their list, or beyond ``listed`` of them a bitmap."""
    known = words.filter("word is not null").select("lang", "word", "n")
    many = known.count()
    if many <= listed:
        return Listed([(r.lang, r.word) for r in known.orderBy(F.desc("n"), "lang", "word").collect()])  # at most LISTED rows
    power = min(max((BITS_PER_WORD * many).bit_length(), FEWEST_BITS), MOST_BITS)
    at = F.xxhash64("lang", "word").bitwiseAND(F.lit((1 << power) - 1))
    flags = np.zeros((1 << power) >> 3, np.uint8)
    for p in known.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("flags")).collect():  # at most 64 MB
        flags[p.part << 12 : (p.part + 1) << 12] = np.frombuffer(p.flags, np.uint8)
    return Flagged(power, flags.tobytes())


# -- suffixes


def _distinct(ids: np.ndarray, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct suffixes of two words or more that start at the first ``rows`` places, -1 where they have ended, and their counts. Numbers are below 2 ** bits - 1."""
    padded = np.append(ids, np.full(MOST, -1, ids.dtype))
    at = [padded[:rows]]
    for k in range(1, MOST):
        at.append(np.where(at[-1] < 0, -1, padded[k : rows + k]))
    long_enough = at[LEAST - 1] >= 0
    at = [c[long_enough] for c in at]
    keys: list[np.ndarray] = []  # as many words in a key as fit, so that one or two keys are sorted
    for i, column in enumerate(at):
        column = column.astype(np.int64) + 1
        if i % (63 // bits):
            keys[-1] = keys[-1] << bits | column
        else:
            keys.append(column)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    if not len(order):
        return np.empty((0, MOST), np.int32), np.empty(0, np.int64)
    changed = np.zeros(len(order) - 1, bool)
    for k in keys:
        k = k[order]
        changed |= k[1:] != k[:-1]
    starts = np.flatnonzero(np.append(True, changed))
    return np.stack([c[order[starts]] for c in at], axis=1), np.diff(np.append(starts, len(order)))


def _suffixes(known: Callable[[], Listed | Flagged], bounds: list[bytes]):
    """For mapInArrow: (part, suffix, n), suffixes as bytes in which words are whole, so that those that share words at the start are one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = known()
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        waiting = 0

        def let_go() -> Iterator[pa.RecordBatch]:
            for ids, arrays in held.values():
                every = np.concatenate(arrays)
                for begin in range(0, len(every), PORTION):
                    rows, counts = _distinct(every[begin : begin + PORTION + MOST], min(PORTION, len(every) - begin), words_known.bits)
                    for first in range(0, len(rows), BATCH):
                        some = slice(first, first + BATCH)
                        keys = words_known.keys(rows[some], ids)
                        yield pa.RecordBatch.from_arrays([pa.array(_parts(keys, bounds)), keys, pa.array(counts[some])], ["part", "suffix", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = words_known.ids(lang), []
                ids, arrays = held[lang]
                words = tokens(text)
                arrays += [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), np.full(1, -1, np.int32)]
                waiting += len(words) + 1
                if waiting > PORTION:
                    yield from let_go()
                    waiting = 0
        yield from let_go()

    return run


def _parts(keys: pa.Array, bounds: list[bytes]) -> np.ndarray:
    """How many of the ascending bounds are not above each key."""
    values = keys.to_pylist()
    if values != sorted(values):  # spelt out in the order of their numbers
        return np.searchsorted(np.array(bounds, object), np.array(values, object), side="right").astype(np.int32) if bounds else np.zeros(len(values), np.int32)
    return np.searchsorted(np.array([bisect_left(values, b) for b in bounds], np.int64), np.arange(len(values)), side="right").astype(np.int32)


_SUFFIXES = "part int, suffix binary, n long"


def _bounds(texts: DataFrame, known: Callable[[], Listed | Flagged], words: int, parts: int) -> list[bytes]:
    """Ascending suffixes that cut all of them into parts of about equal size, from a sample of texts and of their suffixes: some SAMPLE of them leave the executors at most."""
    share = min(1.0, min(PER_BOUND * parts, SAMPLE) / max(words, 1)) ** 0.5
    drawn = texts.sample(share, seed=7).mapInArrow(_suffixes(known, []), _SUFFIXES).sample(share, seed=8)
    got = sorted(bytes(r.suffix) for r in drawn.select("suffix").collect())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


# -- phrases


def _phrases(known: Callable[[], Listed | Flagged], least: int):
    """For mapInArrow over sorted suffixes: (lang, phrase, f) of every prefix of two words or more.

    One stack holds the prefixes of the suffix at hand, and entry k of it goes off, with the count of all suffixes since it
    was put there, at the first suffix that differs within k words. That is done for all rows of a batch at once. Prefixes
    of a batch's first and last suffix may go on in its neighbours, so they come out with whatever they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = known()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, names = words_known.read(batch["suffix"])
            counts = batch["n"].to_numpy()
            out: list[tuple[str, str, int]] = []
            differs = rows[1:, 0] != rows[:-1, 0]
            for k in range(2, MOST + 1):
                differs = differs | (rows[1:, k - 1] != rows[:-1, k - 1])
                pushed = np.flatnonzero(np.append(True, differs))
                total = np.add.reduceat(counts, pushed)
                whole = total >= least
                whole[[0, -1]] = True
                for i in np.flatnonzero(whole & (rows[pushed, k - 1] >= 0)).tolist():
                    at = rows[pushed[i], :k].tolist()
                    out.append((names[at[0]][0], " ".join(names[j][1] for j in at), int(total[i])))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of one to MOST words that occur ``least`` times in their language, and (lang, n) of all languages."""
    texts = _texts(docs)
    words = word_counts(texts, least)
    totals = words.filter("word is null").select("lang", "n")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(words))  # of bounded size
    known = lambda: shared.value
    n = totals.agg(F.sum("n")).first()[0] or 0
    bounds = _bounds(texts, known, n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PER_PARTITION + 1))
    dealt = texts.mapInArrow(_suffixes(known, bounds), _SUFFIXES).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("suffix")
    found = dealt.select("suffix", "n").mapInArrow(_phrases(known, least), "lang string, phrase string, f long")
    many = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    single = words.filter("word is not null").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    return materialise(many.unionByName(single).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f"), "phrases"), totals


def collocations(docs: DataFrame, least: int = 100, best: int = 2000) -> DataFrame:
    """Each language's ``best`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its worst cut into two parts, floor(1000 * a * n / (l * r)). A phrase
    that stands inside a longer one with the same count is left out.
    """
    counts, totals = phrase_counts(docs, least)
    cut = F.expr("explode(transform(sequence(1, k - 1), i -> named_struct('k', i, 'first', array_join(slice(w, 1, i), ' '), 'rest', array_join(slice(w, i + 1, k - i), ' '))))")
    cuts = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).select("lang", "phrase", F.col("k").alias("size"), "a", cut.alias("c")).select("lang", "phrase", "size", "a", "c.*")
    named = lambda part, f: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    joined = keyed_join(keyed_join(cuts, named("first", "l"), ["lang", "first"], "inner"), named("rest", "r"), ["lang", "rest"], "inner")
    joined = materialise(keyed_join(joined, totals, ["lang"], "inner").withColumn("score", F.expr("(cast(1000 * cast(a as decimal(19,0)) * n as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")), "cuts")
    # Inside a longer phrase with the same count there is one of one word more with it: its first part but for a word, or its rest.
    inside = joined.filter("size > 2").select("lang", F.explode(F.expr("filter(array(if(k = size - 1 and l = a, first, null), if(k = 1 and r = a, rest, null)), x -> x is not null)")).alias("phrase")).distinct()
    worst = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    kept = keyed_join(worst, materialise(inside, "inside"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
