"""What a review found missing: each test fails on the code before."""

import random

import pytest

from weirflow.llm import chunk_dedup, mixing, syncmers

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def domain(i):
    return 2 if i % 5 == 0 else 1 if i % 5 == 1 else 0


@pytest.fixture(scope="module")
def three(spark):
    """Three domains with different surfaces, toxic ones far above their target."""
    texts = ["plain words of a good text that says something new each time {}", "!!! $$$ %%% ### *** ??? {} !!! $$$", "GO AWAY YOU TERRIBLE PEOPLE OF NUMBER {}"]
    docs = spark.createDataFrame([(i, texts[domain(i)].format(i)) for i in range(500)], DOCS)
    return docs, spark.createDataFrame([(i, int(domain(i) != 1), int(domain(i) == 2)) for i in range(0, 500, 2)], LABELS)


def test_mixing_totals_meet_targets(three):
    got = mixing.document_rates(*three).collect()
    whole = sum(x.tokens for x in got)
    for d, target in mixing.TARGETS.items():
        assert abs(sum(x.tokens * x.rate * x[f"p_{d}"] for x in got) / whole - target) < 2e-3
    assert min(x.rate for x in got) < 0.3 and all(x.rate >= 0 for x in got)


def test_mixing_reads_words(spark):
    """Toxic texts have the surface of good ones and differ by a word; those that are judged here have no label."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(50)] + ["vexle"]

    def text(i):
        words = [r.choice(vocabulary[:-1]) for _ in range(12)]
        if i % 4 == 0:
            words[r.randrange(12)] = "vexle"
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(800)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], LABELS)
    unseen = [x for x in mixing.document_rates(docs, labels).collect() if x.doc_id >= 400]
    assert all(x.p_toxic > 0.9 if x.doc_id % 4 == 0 else x.p_toxic < 0.1 for x in unseen)


def test_fingerprints_keep_all_anchors_in_order(spark):
    """Two long texts that share one passage are somewhat alike, and a text's fingerprint starts with that of its start."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = text(60)
    a, b = f"{text(3000)} {passage} {text(3000)}", f"{text(2000)} {passage} {text(4000)}"
    docs = spark.createDataFrame([(2, a), (1, b), (0, a[:9000])], DOCS)
    prints = {x.doc_id: x.fingerprint for x in syncmers.fingerprints(docs).collect()}
    assert prints[2].startswith(prints[0][:-8]) and len(prints[2]) > 3.5 * len(prints[0]) > 8 * 1000
    entries = {i: [int(p[k : k + 8], 16) for k in range(0, len(p), 8)] for i, p in prints.items()}
    sets = {i: {(x, y >> 8) for x, y in zip(e, e[1:])} for i, e in entries.items()}
    got = {x.doc_id: x.near_next for x in syncmers.with_neighbours(docs).collect()}
    assert got[2] == pytest.approx(len(sets[2] & sets[1]) / len(sets[2] | sets[1])) and got[2] > 0.003


def test_drop_copies_on_repeated_and_null_ids(spark):
    rows = [(3, "B"), (5, "B"), (5, "A"), (None, "B"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (8, None), (None, ""), (9, "E")]
    left = chunk_dedup.drop_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((x.doc_id or 0, x.text or "") for x in left)) == [(0, "C"), (3, "B"), (5, "A"), (7, "D"), (8, ""), (9, "E")]
