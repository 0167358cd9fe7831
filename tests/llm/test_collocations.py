"""Phrase collocation mining against plain counting."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from weirflow.llm import collocations as C


def brute(rows, least, best):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:j] for q, b in cands.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and c[q[i:j]] <= b}
        got = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                got.append((-score, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(lang, i + 1, *x[3:]) for i, x in enumerate(sorted(got)[:best])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "A", "the", "of", "\x01c", "é", "x" * 40, "d", "日本", "a-b", "\x1f"]
    passage = "one common passage of words that many of the documents share"
    rows = []
    for i in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " "]) for _ in range(r.randrange(60)))
        rows.append((r.choice(["en", "en", "en", "de", None, "und"]), t + (passage if i % 3 == 0 else "")))
    return rows + [("en", None), ("fr", ""), (None, "the of"), ("en", " \t "), ("en", "...")] + rows[:7]


def found(spark, rows, least=5, best=50):
    df = spark.createDataFrame(rows, "lang string, text string").select("lang", "text", F.lit(1).alias("n"), F.lit("x").alias("phrase"), F.lit(0).alias("part"))
    return sorted(tuple(r) for r in C.collocations(df, least, best).collect())


def test_equal_to_counting(spark):
    rows = texts(1, 400)
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, rows, best=3) == brute(rows, 5, 3)


def test_small_portions_and_a_hot_word(spark, monkeypatch):
    """Most suffixes start with one word, portions and batches are small and partitions many: counts go over all their borders."""
    monkeypatch.setattr(C, "PER_PARTITION", 200)
    r = random.Random(2)
    rows = [("en", " ".join(["hot", *r.choices(["hot", "x", "y", "z"], [6, 1, 1, 1], k=30)])) for _ in range(300)]
    assert found(spark, rows) == brute(rows, 5, 50)


@pytest.mark.parametrize("listed", [0, 10**6])
def test_more_frequent_words_than_are_listed(spark, monkeypatch, listed):
    """Suffixes as numbers and spelt out give the same counts, in batches of a few rows."""
    monkeypatch.setattr(C, "lexicon", lambda words, whole=C.lexicon: whole(words, listed))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = texts(3, 200) + [("a b\tc", "w w w w w w w w"), ("a", "b\tc w w w w w w w w")]
    try:
        assert found(spark, rows) == brute(rows, 5, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("known", [C.Listed([("en", w) for w in "gfedcba"]), C.Listed([("en", w) for w in ("gfedcba" + "z" * 70_000)]), C.Flagged(16, b"\xff" * (1 << 13))])
def test_portions_cut_a_text_anywhere(monkeypatch, known):
    """Suffixes across the borders of portions are whole, whatever bytes stand for words."""
    import pyarrow as pa

    monkeypatch.setattr(C, "PORTION", 7)
    monkeypatch.setattr(C, "BATCH", 3)
    text = "a b c d e f a b c. d e f a b c d e f g " * 5
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    got = collections.Counter()
    for out in C._suffixes(lambda: known, [])(iter([batch])):
        rows, names = known.read(out["suffix"])
        for row, n in zip(rows.tolist(), out["n"].to_pylist(), strict=True):
            got[" ".join(names[j][1] for j in row if j >= 0)] += n
            assert all(names[j][0] == "en" for j in row if j >= 0)
    want = collections.Counter()
    for piece in text.split("."):
        w = piece.split()
        for i in range(len(w) - 1):
            want[" ".join(w[i : i + 5])] += 1
    assert got == want
    assert [p for out in C._suffixes(lambda: known, [b"", b"\xff" * 9])(iter([batch])) for p in set(out["part"].to_pylist())][0] == 1


def test_bitmap_holds_all_frequent_words(spark):
    """The executors' hash and the plan's are the same, so no frequent word is missed; most others are told apart."""
    words = spark.createDataFrame([("en", f"wört{i}", 9) for i in range(500)] + [("en", None, 9999)], "lang string, word string, n long")
    ids = C.lexicon(words, 499).ids("en")
    assert all(ids[f"wört{i}".encode()] == i for i in range(500))
    assert sum(ids[f"other{i}".encode()] >= 0 for i in range(1000)) < 150
    assert isinstance(C.lexicon(words, 500), C.Listed)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "only one text of words")]])
def test_odd_tables(spark, rows):
    assert found(spark, rows) == brute(rows, 5, 50) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """The product in a score passes 64 bits and stays exact."""
    big = [("en", "a", 1, 3 * 10**15), ("en", "b", 1, 7 * 10**15), ("en", "a b", 2, 2 * 10**15 + 1)]
    monkeypatch.setattr(C, "phrase_counts", lambda docs, least: (spark.createDataFrame(big, "lang string, phrase string, k int, f long"), spark.createDataFrame([("en", 10**16)], "lang string, n long")))
    got = C.collocations(None).first()
    assert got.score == 1000 * (2 * 10**15 + 1) * 10**16 // (3 * 10**15 * 7 * 10**15) and got.rank == 1
