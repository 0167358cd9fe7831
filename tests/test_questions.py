"""Tables of questions, of names and of windows in one plan, against the operators that take one at a time."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from weirflow.functions import timephrase as T
from weirflow.operators import questions as Q
from weirflow.operators import registry as G
from weirflow.operators import samples as S
from weirflow.operators import sensor_query as O
from weirflow.operators.intervals import within

AT = datetime(2026, 8, 5, 14, 30, tzinfo=timezone.utc)
PHRASES = [
    "last 3 days", "past 2 weeks", "last week", "past week", " LAST\t 1 day ", "previous month", "last 0 days", "last 007 days", "last 99999999 hours", "last 17000000 hours", "last 100000000 hours",
    "latest", "Most  Recent", "last reading", "today", "yesterday", "this week", "this month", "2026-01-01", "2026-01-01 until 2026-01-02", "2026-01-01 - 2026-01-01", "2026-02-30", "2024-02-29",
    "2026-01-02 to 2026-01-01", "2024-01-05 through 2024-02-30", "9999-12-30", "9999-12-31", "0000-01-01", "0001-01-01", "", "  ", "whenever", None, "last hour", "last 1 hours", "past 3 year",
    "last 3 days", "2024-1-5", "last 3 days ago", "a last 3 days", "last 730000 days", "last 730001 days", "last ٣ days",
]


def test_phrases_as_columns(spark):
    """Every phrase as a column is what it is on the driver, and windows are the same."""
    df = spark.createDataFrame(list(enumerate(PHRASES)), "i int, p string").withColumn("x", T.parsed(F.col("p"))).withColumn("r", T.resolved(F.col("x"), F.lit(AT)))
    ms = lambda d: round((d.replace(tzinfo=timezone.utc) - AT).total_seconds() * 1000)
    rows = df.select("i", "x.kind", "x.span_seconds", "x.unit", "x.offset", "r.label", "r.end_inclusive", (F.unix_millis("r.start") - F.unix_millis(F.lit(AT))).alias("a"), (F.unix_millis("r.end") - F.unix_millis(F.lit(AT))).alias("b")).collect()
    for r in rows:
        try:
            p = T.parse(PHRASES[r.i] or "")
        except T.PhraseError:
            assert r.kind is None and r.label is None, PHRASES[r.i]
            continue
        w = T.resolve(p, AT)
        assert (r.kind, r.unit, r.offset, r.span_seconds) == (p.kind, p.unit, p.offset, p.span and int(p.span.total_seconds())), PHRASES[r.i]
        assert (r.label, r.end_inclusive, r.a, r.b) == (w.label, w.end_inclusive, ms(w.start), ms(w.end)), PHRASES[r.i]


@pytest.fixture(scope="module")
def fleet(spark):
    r = random.Random(4)
    rows, n = [], 0
    for d in range(6):
        for _ in range(0 if d == 5 else 400 if d == 0 else 40):
            n += 1
            at = datetime(2026, 7, 1, tzinfo=timezone.utc) + timedelta(minutes=r.randrange(0, 60 * 24 * 30, 30))
            rows.append((d, r.choice(["ph", "turbidity", "dissolved_oxygen"]), at, n, r.choice([None, 1.5, 2.0, 0.0, r.uniform(-5, 9)]), r.random() < 0.8))
    samples = spark.createDataFrame(rows, "device long, metric string, at timestamp, ord long, value double, valid boolean").cache()
    names = [(0, "dev:0", "Harbour Pod One", "salt marsh"), (1, "dev:1", "Harbour Pod Two", None), (2, "dev:2", "Creek", "freshwater"), (3, "dev:3", None, "lake"), (4, "dev:4", "Old Mill Race", "lake"), (5, "dev:5", "Quiet", "lake"), (6, None, "Unlabelled", "lake")]
    return samples, spark.createDataFrame(names, "device long, label string, name string, environment string")


def test_a_table_of_questions(spark, fleet):
    """Each question's rows are those of the call for one question, errors too."""
    samples, devices = fleet
    asked = []
    for i, name in enumerate([*S.AGGREGATIONS, " MEAN", "mode"]):
        for j, (metric, phrase) in enumerate([("ph", "last week"), ("all", "last 30 days"), ("DO", "latest"), ("turbidity", "yesterday"), ("ph", "2026-07-03 to 2026-07-20"), ("salinity", "today"), ("ph", "some day"), ("ph", " ")]):
            asked.append((f"q{i}-{j}", [" DEV:0", "hpt", "creek", "harbour", "dev:5", "nobody", "old m", None, ""][(i + j) % 9], metric, name, phrase, [None, "day", "hour", "auto", "year"][(i * 3 + j) % 5]))
    table = spark.createDataFrame(asked, "question string, device string, metric string, aggregation string, time_range string, bucket string")
    got = {}
    for r in Q.answers(table, samples, devices).collect():
        got.setdefault(r.question, []).append(r)
    assert set(got) == {a[0] for a in asked}
    sample = random.Random(1).sample(asked, 8) + [a for a in asked if a[3] in ("median", "series", "raw") and a[0][-1] in "014"][:6]
    for question, device, metric, name, phrase, bucket in sample:
        want = O.ask_safely(samples, devices, O.SensorQuestion(metric, phrase, name, device, bucket))
        rows = got[question]
        if "error" in want:
            assert [r.error for r in rows] == [want["error"]], question
            continue
        assert {r.metric for r in rows} == set(want["metrics"]), question
        for r in rows:
            w = want["metrics"][r.metric]
            assert r.error is None
            for c in ("device", "label", "aggregation", "n_samples", "excluded_faulted", "observed_at", "range_start", "range_end", "range_label", "last_reported", "bucket_ms", "truncated"):
                assert getattr(r, c) == w[c], (question, c)
            assert (r.value is None) == (w["value"] is None) and (r.value is None or abs(r.value - w["value"]) < 1e-9)
            assert (r.samples and [x.asDict() for x in r.samples]) == w["samples"]
            assert (r.series is None) == (w["series"] is None) and [x.n for x in r.series or []] == [x["n"] for x in w["series"] or []]


def test_default_device_and_no_questions(spark, fleet):
    samples, devices = fleet
    table = spark.createDataFrame([("a", None, "ph", "mean", "last week"), ("b", "dev:1", "ph", "mean", "last week")], "question string, device string, metric string, aggregation string, time_range string")
    assert {r.question: r.label for r in Q.answers(table, samples, devices, "dev:2").collect()} == {"a": "dev:2", "b": "dev:1"}
    assert Q.answers(table.filter("false"), samples, devices).count() == 0
    assert {r.n_samples for r in Q.answers(table, samples.filter("false"), devices, "dev:2").collect()} == {0}


def test_a_table_of_names(spark, fleet):
    """For every name the rows of `matches`."""
    names = ["HPO", " dev:3 ", "pod", "ha", "har", "h", "hp", "old m", "creek", "arb", "zzz", "zz", "z", "", " ", "ee", "omr", "om", "Harbour Pod One", "q", "unl", "ld mill r"]
    rows = [(i, lab, n, "e") for i, (lab, n) in enumerate([("dev:1", "Harbour Pod One"), ("dev:2", "harbour pod one"), ("dev:3", "Creek"), (None, "Unlabelled"), ("hpo", "Other"), ("", ""), ("x", None), ("dev:4", "Old Mill Race"), ("dev:4", "Old Mill Race"), ("zzzz", "Pod of 7 pods")])]
    devices = spark.createDataFrame(rows, "key int, label string, name string, environment string")
    got = sorted((r.asked, r.tier, r.key) for r in G.matches_of(spark.createDataFrame([(n,) for n in [*names, None, "pod"]], "asked string"), devices).collect())
    want = sorted({(n.strip().lower(), r.tier, r.key) for n in names for r in G.matches(devices, n).collect()})
    assert got == want


def test_windows_by_bins(spark):
    """Points in windows as compared one by one: closed and open ends, windows over many bins, nulls, windows that end before they start."""
    r = random.Random(9)
    t = lambda m: AT + timedelta(minutes=m)
    points = [(r.choice(["a", "a", "a", "b", None]), t(r.randrange(-5000, 5000)), i) for i in range(400)] + [("a", None, 999)]
    windows = [(r.choice(["a", "b", None]), t(s := r.randrange(-5000, 5000)), t(s + r.choice([0, 1, 30, 3000, -5])), r.random() < 0.5, j) for j in range(80)] + [("a", None, AT, True, 999)]
    p, w = spark.createDataFrame(points, "site string, at timestamp, i int"), spark.createDataFrame(windows, "site string, s timestamp, e timestamp, closed boolean, j int")
    got = sorted((x.i, x.j) for x in within(p, w, ["site"], "s", "e", width_ms=3_600_000, end_inclusive="closed").collect())
    assert got == sorted((i, j) for a, at, i in points for b, s, e, c, j in windows if a is not None and a == b and at and s and s <= at and (at <= e if c else at < e))


@pytest.mark.parametrize(("ranks", "margin"), [(20, 0), (100, 2), (1000, 32), (100_000, 32)])
def test_medians(spark, ranks, margin):
    """Exact medians from two passes, whatever the sketch and its bounds: hot and small groups, ties, NaN, faults."""
    r = random.Random(ranks)
    rows = [("hot", "m", r.choice([r.gauss(0, 1), 0.0, 5.5, 1e300]), True) for _ in range(5001)] + [(f"d{i % 40}", "m", r.choice([float(r.randrange(5)), None]), r.random() < 0.8) for i in range(300)] + [("none", "m", 1.0, False), ("nan", "m", float("nan"), True), ("nan", "m", 1.0, True), ("nan", "m", 2.0, True)]
    df = spark.createDataFrame(rows, "device string, metric string, value double, valid boolean")
    want = {x.device: x.v for x in df.filter("valid AND value IS NOT NULL").groupBy("device").agg(F.percentile("value", 0.5).alias("v")).collect()}
    assert {x.device: x.value for x in S.medians(df, ranks=ranks, margin=margin).collect()} == want
    assert {x.device: x.value for x in S.aggregate(df, "median").collect()} == {x.device: None for x in df.filter("value IS NOT NULL").collect()} | want


def test_a_table_of_names_sends_nothing_through_the_driver(spark, tmp_path):
    """Files say little of what their names explode to: no side of a join is sent whole. Names that devices share, and letters that change when lowered, match as by `matches`."""
    rows = [(i, f"dev:{i % 40}", ["Kelvin Kay", "Harbour Pod One", "Pod İzmir Two", "harbour pod one", None, "HPO creek"][i % 6]) for i in range(300)]
    spark.createDataFrame(rows, "key int, label string, name string").write.parquet(f"{tmp_path}/d")
    devices = spark.read.parquet(f"{tmp_path}/d")
    names = ["hpo", "har", "hp", "pod", "kk", "kK", "piz", "pi", "pt", "İzm", " DEV:7", "hc", "h", "", "creek", "dev:", "zzz"]
    found = G.matches_of(spark.createDataFrame([(n,) for n in names], "asked string"), devices)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.asked, r.tier, r.key) for r in found.collect())
    asked = {n: spark.range(1).select(F.lower(F.trim(F.lit(n))).alias("a")).first().a for n in names}
    want = sorted({(asked[n], r.tier, r.key) for n in names for r in G.matches(devices, asked[n]).collect()})
    assert got == want and len(got) > 300


def test_a_table_of_questions_stays_off_the_driver(spark, fleet, tmp_path):
    """A small file of questions may be many rows: neither they nor their windows are sent whole to meet devices and samples."""
    samples, devices = fleet
    spark.range(400).select(F.col("id").alias("question"), F.concat(F.lit("dev:"), (F.col("id") % 3).cast("string")).alias("device"), F.lit("all").alias("metric"), F.lit("median").alias("aggregation"), F.lit("last 30 days").alias("time_range")).write.parquet(f"{tmp_path}/q")
    plan = Q.answers(spark.read.parquet(f"{tmp_path}/q"), samples, devices)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [device#" in plan and "BroadcastHashJoin [device#" not in plan
