"""Deduplication, similarity join, packing, fingerprints: against brute force on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import chunk_dedup, packing, syncmers
from weirflow.llm.components import components
from weirflow.llm.parity_join import Similarity, drop_similar, shingle_set, similar_groups

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, rep string, key int, digest string"


def corpus():
    """Copies, near copies of several bases, shared passages, odd rows, and columns whose names the operators use themselves."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bases = [text(n) for n in (150, 150, 40, 300, 12, 30)]
    out = []
    for b in bases:
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 14):
            w = b.split(" ")
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    out += [text(r.randint(1, 80)) for _ in range(60)]
    out += ["the same old line " * 3 + text(20) for _ in range(20)]
    out += [None, "", " \t\n ", "one", "One", "two words", "two  words\n", "a b c", "x" * 20000, "é ü 😀 " * 30, bases[0].upper(), bases[0].replace(" ", "\t\t")]
    r.shuffle(out)
    return [(1000 - i, t, "r", 1, "d") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_exact_groups(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in corpus()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {x.doc_id: x for x in chunk_dedup.exact_groups(docs).collect()}
    assert len(got) == len(norm)
    for i, t in norm.items():
        g = groups[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest())
    left = chunk_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == sorted(min(g) for g in groups.values())


def test_exact_odd_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept) for x in chunk_dedup.exact_groups(df).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert chunk_dedup.exact_groups(df.filter("false")).count() == 0


def test_clashing_short_hashes(spark):
    """Two different chunks with one short hash get different identifiers."""
    raw = spark.createDataFrame([(1, "s", [7, 8], [b"a", b"b"]), (2, "t", [7], [b"c"]), (3, "u", [], [])], "doc_id long, text_sha256 string, short array<long>, proof array<binary>")
    clash = spark.createDataFrame([(7, b"a"), (7, b"c")], "short long, proof binary")
    got = {x.doc_id: x.recipe for x in chunk_dedup.renumbered(raw, clash).collect()}
    assert got[1][1] == 8 and got[3] == [] and len({got[1][0], got[2][0], 7}) == 3


@given(st.binary(max_size=3000), st.binary(max_size=600))
@settings(max_examples=50, deadline=None)
def test_chunks(data, front):
    cuts = chunk_dedup.cut_points(data)
    assert (cuts == sorted(set(cuts)) and cuts[-1] == len(data)) if data else cuts == []
    assert all(b - a <= chunk_dedup.MOST for a, b in zip([0, *cuts], cuts))


def test_chunks_resynchronise():
    data = random.Random(3).randbytes(200_000)

    def own(x):
        cuts = chunk_dedup.cut_points(x)
        return {x[a:b] for a, b in zip([0, *cuts], cuts)}

    assert len(own(data) & own(b"new start" + data)) > 0.95 * len(own(data))


def brute(rows, sim):
    sets = {i: frozenset(shingle_set(t, sim.width).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and sim.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("sim", [Similarity(3, 90), Similarity(5, 80), Similarity(2, 60)])
def test_similar_groups(docs, sim):
    want = brute([(i, t) for i, t, *_ in corpus()], sim)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar_groups(docs, sim).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())
    if sim.percent == 80:
        left = drop_similar(docs, sim)
        assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {c for _, c in want.values()}


def test_shingles_are_distinct_words():
    words = "b a n a n a s a n a n a".split()
    for k in (1, 2, 3, 20):
        plain = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}
        assert len(shingle_set(" ".join(words).upper(), k)) == len(plain)
    assert len(shingle_set("é\x85x y", 3)) == 1 and len(shingle_set(None, 3)) == 0


@pytest.mark.parametrize("sim", [Similarity(3, 60), Similarity(5, 80), Similarity(3, 90)])
@given(base=st.sets(st.integers(0, 2**64 - 1), min_size=5, max_size=90), edits=st.integers(0, 30), r=st.randoms())
@settings(max_examples=60, deadline=None)
def test_linked_sets_share_a_listed_block(sim, base, edits, r):
    a = set(base)
    b = set(r.sample(sorted(a), max(1, len(a) - edits))) | {r.getrandbits(64) for _ in range(r.randint(0, edits))}
    whole = lambda s: np.array(sorted(s), np.uint64)
    if not (bands := sim.bands_of(max(len(a), len(b)))):
        assert a == b or not sim.linked(len(a & b), len(a), len(b))
        return
    band = bands[0]
    (x, u), (y, v) = sim.sketch(whole(a), band), sim.sketch(whole(b), band)
    assert int(np.bitwise_count(sim.folded(x, band) ^ sim.folded(y, band)).sum()) <= len(a ^ b)
    if sim.linked(len(a & b), len(a), len(b)):
        assert band in sim.bands_of(min(len(a), len(b)))
        assert np.intersect1d(sim.listed(len(a), band, x, u), sim.listed(len(b), band, y, v)).size


def test_pairs_of_a_large_bucket(spark):
    """Members of one bucket are compared across components, in blocks, as all pairs would be."""
    from weirflow.llm import parity_join

    sim, r = Similarity(3, 90), np.random.Generator(np.random.PCG64(1))
    sets = [np.unique(r.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([s[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)])) for s in sets for k in (0, 1, 2, 3)]
    folded = [sim.folded(sim.sketch(s, 5)[0], 5) for s in sets]
    import pyarrow as pa

    rows = [{"key": 1, "i": 0, "j": 0, "node": k, "component": k % 7, "block": 0, "n_shingles": len(s), "words": f.view(np.int64).tolist()} for k, (s, f) in enumerate(zip(sets, folded, strict=True))]
    found = [b for b in parity_join._across(sim)(iter([pa.RecordBatch.from_pylist(rows[:20]), pa.RecordBatch.from_pylist(rows[20:])]))]
    got = {tuple(p) for b in found for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {
        (i, j) for j in range(len(sets)) for i in range(j)
        if i % 7 != j % 7 and 100 * min(len(sets[i]), len(sets[j])) >= 90 * max(len(sets[i]), len(sets[j]))
        and int(np.bitwise_count(folded[i] ^ folded[j]).sum()) * 190 <= 10 * (len(sets[i]) + len(sets[j]))
    }
    assert got == want and want
    closest = [b for b in parity_join._across(sim, True)(iter([pa.RecordBatch.from_pylist(rows)]))]
    firsts = [t for b in closest for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    share = lambda i, j: int(np.bitwise_count(folded[i] ^ folded[j]).sum()) / (len(sets[i]) + len(sets[j]))
    least = {}
    for i, j in want:
        two = tuple(sorted((i % 7, j % 7)))
        least[two] = min(least.get(two, 1.0), share(i, j))
    assert {tuple(sorted((i % 7, j % 7))): share(i, j) for i, j, _ in firsts} == least and len(firsts) == len(least)
    assert all((i, j) in want and key == 1 for i, j, key in firsts)


def test_two_components_whose_closest_pair_is_no_link(spark):
    """Texts of a bucket whose closest pair by sketches is not linked still get every link that another pair has."""
    r = np.random.Generator(np.random.PCG64(5))
    base, rows = [f"w{x}" for x in r.integers(0, 10**6, 120)], []
    for i in range(60):
        words = list(base)
        for _ in range(int(r.integers(0, 9))):
            words[int(r.integers(0, len(words)))] = f"x{int(r.integers(0, 10**6))}"
        rows.append((i, " ".join(words)))
    sim = Similarity(5, 80)
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    least = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), sim).collect()}
    assert got == dict(enumerate(least)) and 1 < len(set(least)) < 60


def test_join_odd_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (1, "x y z"), (None, "p q r"), (None, "p q r"), (None, None), (4, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in similar_groups(df, Similarity(3, 90)).collect())
    assert got == sorted([("1", 2, "1")] * 2 + [("2", 2, "1"), ("3", 0, "3"), ("None", 2, "1"), ("1", 1, "1"), ("4", 1, "1"), ("None", 1, "None"), ("None", 1, "None"), ("None", 0, "None")])
    assert similar_groups(df.filter("false")).count() == 0
    left = sorted((str(x.doc_id), str(x.text)) for x in drop_similar(df, Similarity(3, 90)).collect())
    assert left == [("1", "a b c d"), ("1", "x y z"), ("3", "None"), ("None", "None"), ("None", "p q r")]
    assert drop_similar(df.filter("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(i, 200) for i in range(100, 160)] + [(300, 300), (41, 40), (5, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(42)) and all(got[i] == 100 for i in range(101, 160)) and got[200] == 100


def test_tokenizer_equals_library():
    from tokenizers import Tokenizer

    t = packing.WordTokenizer(PATH)
    texts = [x or "" for _, x, *_ in corpus()] + ["it's we'll don'T", "İstanbul", "ab\x1fcd", "Σας ΣΑΣ", "áb", "<|endoftext|> hi", "3²½4 x_y", "ſŉ Ĳ", "ﬁ Éléphant", "a\xa0b\x85c"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    import pyarrow as pa

    for end in (None, None, 1):
        ids, ends = t.batch(pa.array(texts), end)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [w + [end] * (end is not None) for w in want]
    ids, ends = t.batch(pa.array(texts[:9] + [""] * 3).slice(2, 10))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[2:9] + [[]] * 3
    assert [x.tolist() for x in t.batch(pa.array([], pa.string()), 1)] == [[], [0]]


def test_pack(docs, spark):
    from tokenizers import Tokenizer

    rows = corpus()
    ids = {i: [*e.ids, 1] for (i, *_), e in zip(rows, Tokenizer.from_file(PATH).encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False), strict=True)}
    for capacity in (64, 4096):
        got = packing.pack(docs, PATH, capacity).collect()
        by, filled = collections.defaultdict(list), collections.defaultdict(list)
        for x in got:
            by[x.doc_id].append(x)
            filled[x.sequence_id].append((x.offset, x.length))
        assert by.keys() == ids.keys()
        for i, own in by.items():
            own.sort(key=lambda x: x.piece)
            assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids[i])
            for x in own:
                assert x.ids_crc32 == zlib.crc32(np.array(ids[i][x.start : x.start + x.length], "<u4").tobytes())
                assert x.length == capacity or x is own[-1]
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) <= 1.02 * decreasing([x.length for x in got], capacity) + 1
    assert packing.pack(docs.filter("false"), PATH).count() == 0


def decreasing(lengths, capacity):
    """How many sequences best-fit decreasing fills, written out."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@given(st.lists(st.integers(1, 50), max_size=120), st.lists(st.integers(1, 40), max_size=20))
@settings(max_examples=80, deadline=None)
def test_best_fit_is_best_fit_decreasing(lengths, gaps):
    lengths = sorted(lengths, reverse=True)
    places, free = packing.best_fit(lengths, [(g, i) for i, g in enumerate(gaps)], 50, True)
    left = dict(enumerate(gaps))
    for i, (n, (name, took)) in enumerate(zip(lengths, places, strict=True)):
        fits = [g for g in left.values() if g >= n]
        assert took == (min(fits) if fits else 50) and (name == -1 - i) == (not fits)
        left[name] = took - n
    assert sorted(g for g in left.values() if g) == [g for g, _ in free]
    some, _ = packing.best_fit(lengths, [(g, i) for i, g in enumerate(gaps)], 50, False)
    assert [p is None for p in some] == [True] * len(some) if not gaps else all(p is None or p[1] >= n for p, n in zip(some, lengths, strict=True))


@pytest.mark.parametrize("kind", ["mixed", "one length", "tiny"])
def test_rounds_over_many_slices(spark, kind):
    """With slices of a few rows pieces are placed once, gapless, in hardly more sequences than best-fit decreasing takes."""
    r = random.Random(kind)
    draw = {"mixed": lambda: min(4096, int(r.lognormvariate(5.5, 1.5)) + 1), "one length": lambda: r.choice([700, 700, 700, r.randint(1, 4096)]), "tiny": lambda: r.randint(1, 60)}[kind]
    lengths = [draw() for _ in range(3000)]
    made = spark.createDataFrame([(i // 2, i % 2, 0, n, 7, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, node long").repartition(4)
    got = packing.place(made, slice_rows=250).collect()
    assert sorted((x.doc_id, x.piece, x.length) for x in got) == sorted((i // 2, i % 2, n) for i, n in enumerate(lengths))
    filled = collections.defaultdict(list)
    for x in got:
        filled[x.sequence_id].append((x.offset, x.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= 1.02 * decreasing(lengths, 4096) + 12


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12), st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
@settings(max_examples=200, deadline=None)
def test_successors_are_those_of_a_sweep_piece_by_piece(waiting, gaps):
    runs, none = packing.successors(waiting, gaps)
    order = [g for g in sorted(gaps) for _ in range(gaps[g])]
    want, left = collections.Counter(), sorted(x for x, n in waiting.items() for _ in range(n))
    for place, g in enumerate(order):
        if fits := [x for x in left if x <= g]:
            left.remove(max(fits))
            want[max(fits), place] += 1
    got = collections.Counter((size, place + k) for size, first, last, place in runs for k in range(last - first))
    assert got == want and none == collections.Counter(left)
    for size, n in waiting.items():
        own = sorted([(a, b) for s, a, b, _ in runs if s == size] + ([(0, none[size])] if size in none else []))
        assert [a for a, _ in own] + [n] == [0] + [b for _, b in own]  # each number of a size is in one run


def test_many_slices_fill_gaps_that_fit_exactly(spark):
    """Pieces that only one size of gap takes well: with 15 slices at most 0.5 % more sequences than best-fit decreasing, and rounds until nothing fits."""
    lengths = [2096] * 5000 + [3496] * 5000 + [1900] * 5000
    random.Random(5).shuffle(lengths)
    made = spark.createDataFrame([(i, 0, 0, n, 7, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, node long").repartition(4)
    got = packing.place(made, slice_rows=1000)
    assert got.count() == 15000 and got.select("sequence_id").distinct().count() <= 1.005 * 10000


def plain_fingerprints(spark, texts):
    """Fingerprints and sets of places written out, with the engine's own hash."""
    pair = {}

    def hashed(wanted):
        wanted = sorted(set(wanted))
        got = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "i int, a long, b long").selectExpr("i", "xxhash64(a, b)").collect()
        pair.update({wanted[i]: h for i, h in got})

    own = sorted({t[i : i + syncmers.S] for t in texts for i in range(len(t) - syncmers.S + 1)})
    single = dict(zip(own, [r[1] for r in sorted(spark.createDataFrame(list(enumerate(own)), "i int, t string").selectExpr("i", "xxhash64(t)").collect())], strict=True))
    nines = [[single[t[i : i + syncmers.S]] for i in range(len(t) - syncmers.S + 1)] for t in texts]
    closed = [[i for i in range(len(h) - syncmers.WIDTH + 1) if min(h[i : i + syncmers.WIDTH]) in (h[i], h[i + syncmers.WIDTH - 1])] for h in nines]
    want = [[(h[i], h[i + syncmers.WIDTH - 1]) for i in c] for h, c in zip(nines, closed, strict=True)]
    hashed([w for ws in want for w in ws])
    whole = dict(zip(texts, [r[1] & 0xFFFFFFFF for r in sorted(spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", "xxhash64(t)").collect())], strict=True))
    out = []
    for t, c, w in zip(texts, closed, want, strict=True):
        names = [pair[x] & 0xFFFFFF for x in w]
        entries = [h << 8 | (min(255, c[k + 1] - c[k]) if k + 1 < len(c) else 255) for k, h in enumerate(names)]
        entries = entries or ([whole[t]] if t else [])
        out.append(("".join(f"{e:08x}" for e in entries), {(a, b >> 8) for a, b in zip(entries, entries[1:])} or set(entries)))
    return out


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_syncmers(spark, docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    got = {x.doc_id: x for x in syncmers.with_neighbours(docs).collect()}
    assert len(got) == len(rows)
    edited = []
    for n, (_, t) in enumerate(rows):
        third = len(t) // 3
        edited.append(t[: len(t) - third] + rows[(n + 1) % len(rows)][1][:third])
    own, changed = plain_fingerprints(spark, [t for _, t in rows]), plain_fingerprints(spark, edited)
    for n, (i, t) in enumerate(rows):
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited[n].encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (own[n][0], changed[n][0])
        assert x.near_edited == pytest.approx(alike(own[n][1], changed[n][1])) and x.near_next == pytest.approx(alike(own[n][1], own[(n + 1) % len(rows)][1]))
    long = [x for x in got.values() if x.n_chars > 400]
    assert sum(x.near_edited for x in long) / len(long) > 0.35
    plain = {x.doc_id: x.fingerprint for x in syncmers.fingerprints(docs).collect()}
    assert plain == {i: x.fingerprint for i, x in got.items()}


def test_syncmers_match_positions(spark):
    """A shared passage counts; the same words in another order do not."""
    r = random.Random(6)
    ws = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    other = ws[:]
    r.shuffle(other)
    df = spark.createDataFrame([(3, " ".join(ws)), (2, " ".join(ws[100:] + ws[:100])), (1, " ".join(other))], "doc_id long, text string")
    got = {x.doc_id: x.near_next for x in syncmers.with_neighbours(df).collect()}
    assert got[3] > 0.9 and got[2] < 0.02


def test_syncmers_odd_tables(spark):
    df = spark.createDataFrame([(5, "x" * 40), (5, "x" * 40), (None, "null id"), (3, None)], "doc_id long, text string")
    got = syncmers.with_neighbours(df).collect()
    assert sorted(x.n_chars for x in got) == [0, 7, 40, 40]
    alone = syncmers.with_neighbours(df.filter("doc_id = 3")).first()
    assert (alone.fingerprint, alone.near_next) == ("", 1.0)
    assert syncmers.with_neighbours(df.filter("false")).count() == 0


def test_syncmers_of_an_id_that_most_rows_share(spark):
    """Rows of one id are spread over buckets, and every row is followed by the next one in the whole order."""
    rows = [(i % 7 if i % 3 else 4, f"{i:05d} some words") for i in range(400)] + [(None, f"{i:05d} none") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    buckets = syncmers._in_buckets(df).filter("extra = 0").groupBy("bucket").count()
    assert buckets.agg({"count": "max"}).first()[0] < 150
    tie = {r.text: r.tie for r in df.selectExpr("text", "shiftrightunsigned(xxhash64(text), 12) AS tie").collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -tie[x[1]]))
    got = {(x.doc_id, x.edited_sha256) for x in syncmers.with_neighbours(df).collect()}
    for n, (i, t) in enumerate(order):
        third = len(t) // 3
        assert (i, hashlib.sha256((t[: len(t) - third] + order[(n + 1) % len(order)][1][:third]).encode()).hexdigest()) in got
