"""Revisits, personal data, mixing and the pipeline: against brute force, and every odd case."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weirflow.llm import mixing, pii, revisits

RECORDS = "record_id string, record_type string, target_uri string, captured long, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, url int"


def record(i, kind, uri, at, etag=None, modified=None, digest=None, headers=()):
    return (i, kind, uri, at, etag, modified, digest, list(headers), 0)


def test_canonical_url(spark):
    urls = {
        "HTTP://user@WWW.Example.com:80/a//?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2", "https://example.com": "example.com/", "//m.example.com/x/?ref=1": "m.example.com/x",
        "not a url": "not a url", " https://e.org:8080/ ": "e.org:8080/", "http://e.org/a?": "e.org/a",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()} == urls


def test_resolve(spark):
    u, h = "http://x.org/a", [("etag", "t1"), ("content-type", "html"), ("date", "1")]
    rows = [
        record("a", "response", u, 10, "t1", "m1", "d1", h), record("b", "response", "https://www.x.org/a", 20, "t2", "m2", "d2", h), record("c", "response", u, 20, "t3", "m3", "d3", h),
        record("r0", "revisit", u, 10, "t1"), record("r1", "revisit", u, 15, "W/t1", None, None, [("date", "9"), ("content-length", "0"), ("vary", "x")]), record("r2", "revisit", u + "#f", 21, "t2"),
        record("r3", "revisit", u, 30, None, "m3"), record("r4", "revisit", u, 31), record("r5", "revisit", u, 32, None, None, "d3"), record("r6", "revisit", "http://y.org/", 99, "t1"),
        record("r7", "revisit", None, 5, "t1"), record("r8", "revisit", u, None, "t1"), ("r9", "revisit", u, 40, "t3", None, None, None, 0),
    ]
    df = spark.createDataFrame(rows + [rows[4]], RECORDS)
    got = revisits.resolve(df).collect()
    assert len(got) == 11
    by = {x.record_id: x for x in got}
    assert {k: (x.status, x.base_record_id, x.validator) for k, x in by.items()} == {
        "r0": ("no_base", None, None), "r1": ("resolved", "a", "etag"), "r2": ("mismatch", "c", "etag"), "r3": ("resolved", "c", "last-modified"), "r4": ("unverified", "c", None),
        "r5": ("resolved", "c", "digest"), "r6": ("no_base", None, None), "r7": ("no_base", None, None), "r8": ("no_base", None, None), "r9": ("resolved", "c", "etag"),
    }
    assert by["r1"].headers == "content-type: html\ndate: 9\netag: t1\nvary: x" and by["r1"].payload_digest == "d1" and by["r2"].payload_digest is None
    assert revisits.resolve(df.filter("false")).count() == 0


def test_hot_url_over_buckets(spark):
    """One URL with all records: bases are found across buckets of time."""
    rows = [record(f"p{i:04d}", "response" if i % 7 == 0 else "revisit", "http://hot.org/", i, "t") for i in range(3000)]
    got = {x.record_id: x.base_record_id for x in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {f"p{i:04d}": f"p{i - i % 7:04d}" for i in range(3000) if i % 7}


def test_one_instant_of_a_hot_url(spark):
    """Many responses and revisits at the same instants: the greatest record id of the latest earlier instant counts; records without URL or time are many, too."""
    u = "http://hot.org/"
    rows = [record(f"a{i:03d}", "response", u, 10, "t", digest=f"d{i}") for i in range(300)] + [record(f"b{i:03d}", "response", u, 20, "t") for i in range(300)]
    rows += [record(f"r{i:03d}", "revisit", u, 10 + 10 * (i % 3), "t") for i in range(300)] + [record(f"n{i}", "revisit", None if i % 2 else u, 5 if i % 2 else None) for i in range(300)]
    got = {x.record_id: (x.status, x.base_record_id) for x in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    want = {f"r{i:03d}": (("no_base", None), ("resolved", "a299"), ("resolved", "b299"))[i % 3] for i in range(300)}
    assert got == want | {f"n{i}": ("no_base", None) for i in range(300)}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)), collections.Counter(k for _, k, _ in out)


TEXTS = [
    "a@b.c_d@e.f x@y x..y@z-.q.r. 1.2.3.4.5.6.7.8 001.02.0300.4 1.2.3.0256 999.1.1.1 4111 1111-1111 1111 4111111111111111 +1 (614) 555-8001. + 5", None, "",
    "😀 mail me: joe (at) site (dot) com or call (614) 555-8001 now é 10[.]0[.]0[.]1 token 4111111111111112", "1" * 3000, "a" * 5000 + "@", "a.b@c.d e@f.g" * 50, "5. 6. 7 +49 30 1234567, 4.4.4.4@x.y.z",
    "write to ann@site.org or ring +44 20 7946 0958", "nothing here at all", "0.0.0.0 255.255.255.255 256.1.1.1 1.1.1.1.1", "+12345678 +123456789 +1234567890123456",
]


def test_personal_spans(spark):
    df = spark.createDataFrame([(i, t, "z", 7) for i, t in enumerate(TEXTS * 2)] + [(None, TEXTS[0], "z", 7)], "doc_id long, text string, all string, base int")
    got = pii.personal_spans(df).collect()
    assert len(got) == 2 * len(TEXTS) + 1
    for x in got:
        t = TEXTS[(x.doc_id or 0) % len(TEXTS)] or ""
        want, n = base(t)
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and [x.n_email, x.n_ip, x.n_card, x.n_phone] == [n[k] for k in range(4)]
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))
    wide = [x.spans for x in got if x.doc_id == 3][0]
    assert "phone:" in wide and "email:" in wide
    assert all(x.spans == "" for x in got if x.doc_id in (1, 2, 9))
    assert pii.personal_spans(df.filter("false")).count() == 0 and pii.personal_spans(df.filter("doc_id = 9")).first().spans == ""


def test_estimated_reliabilities():
    """Labelers of known accuracy on two kinds of candidates: the better one is trusted more, and the classifier follows."""
    ballots = [(0, [1, 1, 0, 1, 1], 80), (0, [1, -1, 0, 1, 1], 20), (2, [-1, -1, 0, 1, -1], 90), (2, [-1, 1, 0, 1, -1], 10)]
    m = pii.estimate(ballots)
    assert m.reliability["pattern"] > m.reliability["gazetteer"] > 0.5 and m.prior["email"] > 0.8 > 0.2 > m.prior["card"]
    score = lambda k, v: sum(a * b for a, b in zip(m.weights, pii._encode(k, v), strict=True))
    assert score(0, [1, 1, 0, 1, 1]) > 0 > score(2, [-1, -1, 0, 1, -1])
    assert sum(a * b for a, b in zip(pii.estimate([]).weights, pii._encode(0, [1, 1, 1, 1, 1]), strict=True)) < 0


@pytest.fixture(scope="module")
def mix(spark):
    good, poor = "plain words of a good text that says something new each time {}", "!!! $$$ %%% ### *** ??? {} !!! $$$"
    rows = [(i, (poor if i % 4 == 0 else good).format(i), "x", i) for i in range(400)] + [(900, None, "x", 0), (901, "", "x", 0), (None, "no id", "x", 0), (1, good.format(1), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, tokens int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rates(mix):
    docs, labels = mix
    got = mixing.document_rates(docs, labels, {"good": 0.9, "poor": 0.09, "toxic": 0.01}).collect()
    assert len(got) == 404 and all(mixing.LEAST <= x.rate <= mixing.MOST for x in got)
    assert all(abs(x.p_good + x.p_poor + x.p_toxic - 1) < 1e-9 for x in got)
    known = [x for x in got if x.doc_id is not None and x.doc_id < 400]
    assert all((x.p_good > x.p_poor) == (x.doc_id % 4 > 0) for x in known)
    share = lambda w: sum(x.tokens * w(x) * x.p_good for x in got) / sum(x.tokens * w(x) for x in got)
    assert share(lambda x: 1) < share(lambda x: x.rate) <= 0.93
    assert [x.tokens for x in got if x.doc_id in (900, 901)] == [0, 0]
    assert mixing.document_rates(docs.filter("false"), labels).count() == 0
    assert {x.rate for x in mixing.document_rates(docs, labels.filter("false")).collect()} == {1.0}


def test_rates_are_the_optimum(mix):
    """The projected gradient's result against many small steps in plain Python on the documents themselves."""
    docs, labels = mix
    targets = {"good": 0.9, "poor": 0.09, "toxic": 0.01}
    got = mixing.document_rates(docs, labels, targets).collect()
    whole = sum(x.tokens for x in got)
    p = [(x.p_good, x.p_poor, x.p_toxic) for x in got]
    w = [x.tokens / whole for x in got]
    natural = [sum(a * q[k] for a, q in zip(w, p, strict=True)) for k in range(3)]
    budget = min(mixing.GROWTH, max(n / t for n, t in zip(natural, targets.values(), strict=True)))
    rates = [1.0] * len(got)
    for _ in range(1500):
        miss = [sum(a * q[k] * r for a, q, r in zip(w, p, rates, strict=True)) - budget * t for k, t in enumerate(targets.values())]
        rates = [min(mixing.MOST, max(mixing.LEAST, r - 0.9 * (sum(a * b for a, b in zip(q, miss, strict=True)) + mixing.PULL * (r - 1)))) for q, r in zip(p, rates, strict=True)]
    assert max(abs(a - x.rate) for a, x in zip(rates, got, strict=True)) < 0.05


def test_mixed(mix):
    docs, labels = mix
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    n = collections.Counter(x.doc_id for x in out.collect())
    assert set(n) == {r.doc_id for r in docs.collect()} and max(n[i] for i in n if i != 1) <= mixing.MOST


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2
    clean = [(i, f"document number {i} tells of thing {i * 7} and of matter {i * 11} in its own words {i}", "en", "s", 60) for i in range(10, 90)]
    toxic = [(i, f"document {i} vexling grubnard {i * 13} snarfle", "en", "s", 30) for i in range(100, 140)]
    rows = clean + toxic + [(1, near, "en", "s", 9), (2, near.replace("mu", "MU", 1) + "end", "en", "s", 9), (3, near.replace(" ", "  "), "en", "s", 9), (4, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(10, 140)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {x.doc_id for x in out.collect()} == {i for i, *_ in clean} | {1, 4}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, repeated rows, ties, a very long text, and further columns with clashing names, in every stage."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _wf_row string, _wf_id int, rate double, `a``b` string, node string, component int"
    tail = ("r", 1, 0.5, "t", "n", 2)
    long = " ".join(f"w{i * i % 99991}" for i in range(400_000))
    rows = [(1, "one and the same text here", "en", "s", 1, *tail)] * 3 + [(None, "one and the same text here", None, None, None, *tail), (None, "text of nobody at all", None, None, None, None, None, None, None, None, None)]
    rows += [(2, None, None, None, None, *tail), (3, "", "en", None, 0, *tail), (4, long, "en", "s", None, *tail), (5, long + " end", "en", "s", None, *tail), (5, "another text of the same id", "en", "s", 2, *tail)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.filter("false"), str(tmp_path))
        assert none.count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, None}
            continue
        assert out.columns == none.columns == docs.columns
        got = out.collect()
        if name == "exact_dedup":
            assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in got) == [("1", "one and"), ("2", ""), ("4", "w0 w1 w"), ("5", "another"), ("5", "w0 w1 w"), ("None", "text of")]
        elif name == "near_dedup":
            assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in got) == [("1", "one and"), ("2", ""), ("3", ""), ("4", "w0 w1 w"), ("5", "another"), ("None", "text of")]
        else:
            assert len(got) == 10
        assert {r["a`b"] for r in got} <= {"t", None}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == {1, 2, 4, 5, None}


def test_what_stands_beside_matches_is_what_the_text_has_there(spark):
    rng = random.Random(3)
    some = ["a@b.co", "+1 (555) 123-4567", "10.0.0.1", "4111 1111 1111 1111", "mail", "é", "x" * 40, " ", "\n", "1", "22", "😀", "555-123-4567", "me (at) site dot com", "1[.]2[.]3[.]4", "+12", "."]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = pii._candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(len(r.checked) for r in rows) > 1000
    for r in rows:
        for s in (c.s for c in r.checked):
            assert r.text[s.start : s.end] == s.x
            assert s.ahead == r.text[max(0, s.start - pii.CONTEXT) : s.start] and s.after == r.text[s.end : s.end + 1]


def test_many_matches_in_one_text(spark):
    """A text of 40,000 addresses: time grows with the number of matches, not with its square (minutes, if it did)."""
    text = " ".join(f"u{i}@x{i % 7}.com" for i in range(30_000)) + " " + " ".join(f"call 555-123-{i:04d} now" for i in range(10_000))
    got = pii.personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s.split(":") for s in got.spans.split(",")]
    assert got.n_email == 30_000 and sum(k == "email" for k, *_ in spans) == 30_000 and len(spans) in (30_000, 40_000)
    assert all("@" in text[int(a) : int(b)] for k, a, b in spans[:50] if k == "email")


def test_wider_forms_are_added_beside_words_that_speak_for_them(spark):
    """Planted recall by kind. (Forms beside words that speak against them are added too where all other labelers agree: see README.)"""
    good = {"email": "please write to mail jo{} (at) site (dot) com today", "ip": "the server address is 10[.]0[.]{}[.]7 here", "phone": "you may call 555-123-{:04d} now"}
    kinds = list(good)
    rows = [(i, good[kinds[i % 3]].format(i)) for i in range(180)]
    rows += [(1000 + i, f"write to person{i}@site.com or call +1 555 123 {i:04d}, server 10.0.0.{i}") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, kind in enumerate(kinds):
        assert sum(got[i].startswith(kind) for i in range(k, 180, 3)) >= 54
