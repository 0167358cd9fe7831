import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalars as fn
from weirflow.operators import corpus as C
from weirflow.operators import dimensions as D
from weirflow.operators import evaluation as E
from weirflow.operators import registry as G
from weirflow.operators import report as R
from weirflow.operators import retrieval as V
from weirflow.operators import samples as S

DAY = datetime(2026, 8, 1)
SAMPLE = "device long, metric string, at timestamp, ord long, value double, valid boolean"


def rows(df):
    return [tuple(r) for r in df.collect()]


def made(spark, cells):
    return spark.createDataFrame([(1, "ph", DAY + timedelta(hours=h), i, v, ok) for i, (h, v, ok) in enumerate(cells)], SAMPLE)


BASE = [(12, 7.4, True), (9, 9.2, True), (15, 5.0, True), (6, 6.0, True)]


@pytest.mark.parametrize(("name", "value"), [("min", 5.0), ("max", 9.2), ("mean", 6.9), ("median", 6.7), ("latest", 5.0), ("earliest", 6.0)])
def test_aggregates(spark, name, value):
    r = S.aggregate(made(spark, BASE), name).first()
    assert abs(r.value - value) < 1e-9 and (r.n_samples, r.excluded_faulted) == (4, 0)


def test_faults_and_zero(spark):
    r = S.aggregate(made(spark, [(1, 8.0, True), (2, 99.9, False), (3, 6.0, True)]), "max").first()
    assert (r.value, r.n_samples, r.excluded_faulted) == (8.0, 2, 1)
    r = S.aggregate(made(spark, [(1, 4.0, False)]), "mean").first()
    assert (r.value, r.n_samples, r.excluded_faulted) == (None, 0, 1)
    r = S.aggregate(made(spark, [(1, 0.0, True), (2, 0.0, True), (3, 6.0, True)]), "median").first()
    assert r.value == 0.0


def test_empty_group_on_spine(spark):
    spine = spark.createDataFrame([(1, "ph"), (1, "orp")], "device long, metric string")
    out = {r.metric: (r.value, r.n_samples) for r in S.on_spine(S.aggregate(made(spark, BASE), "max"), spine).collect()}
    assert out == {"ph": (9.2, 4), "orp": (None, 0)}


def test_raw_cap(spark):
    s = made(spark, [(i / 60, float(i), True) for i in range(250)])
    got = S.raw(s, 200).orderBy("at").collect()
    assert (got[0].value, got[-1].value, got[0].n_samples, got[0].truncated) == (50.0, 249.0, 250, True)


def test_series(spark):
    s = made(spark, [(i / 6, float(i % 6), True) for i in range(36)])
    got = S.series(s, "hour").orderBy("start_ms").collect()
    assert [(r.n, r.min, r.max, r["mean"]) for r in got] == [(6, 0.0, 5.0, 2.5)] * 6
    assert S.series(made(spark, [(0, 1.0, True), (5, 2.0, True)]), "hour").count() == 2
    capped = S.series(made(spark, [(h, float(h), True) for h in range(100)]), "hour", 10)
    assert capped.count() == 10 and capped.agg(F.max("max")).first()[0] == 99.0


def test_all_equals_singles(spark):
    s = made(spark, BASE).unionByName(made(spark, [(15, 1.0, True), (16, 9.0, False)]).withColumn("metric", F.lit("orp")))
    for name in ("mean", "latest", "median"):
        r = S.all_metrics(s, name).first()
        assert {k: (v.value, v.n_samples, v.excluded_faulted) for k, v in r.metrics.items()} == {x.metric: (x.value, x.n_samples, x.excluded_faulted) for x in S.aggregate(s, name).collect()}
        assert (r.n_most, r.excluded_faulted) == (4, 1)
    assert S.all_metrics(s, "latest").first().observed_at == DAY + timedelta(hours=15)
    assert S.all_metrics(s, "mean").first().observed_at is None
    with pytest.raises(ValueError):
        S.statistic("mode")


def test_window_edges(spark):
    s = made(spark, [(0, 1.0, True), (24, 2.0, True), (48, 3.0, False)])
    assert S.in_window(s, "last 1 day").count() == 2
    r = S.aggregate(S.in_window(s, "latest"), "latest").first()
    assert (r.value, r.n_samples, r.excluded_faulted) == (None, 0, 1)


def series(spark, values, metric="ph", lo=6.5, hi=8.5, step=0.5):
    return spark.createDataFrame([(1, metric, DAY + timedelta(hours=step * i), i, float(v), float(lo), float(hi)) for i, v in enumerate(values)], "site long, metric string, at timestamp, ord long, value double, baseline_min double, baseline_max double")


def test_excursions(spark):
    assert R.excursions(series(spark, [7.2] * 9)).isEmpty()
    assert R.excursions(series(spark, [7.2] * 4 + [5.0] + [7.2] * 4)).isEmpty()
    r = R.excursions(series(spark, [7.2, 7.2, 5, 5, 5, 7.2])).first()
    assert (r.window_end - r.window_start) == timedelta(hours=1)


def test_interval_merge(spark):
    w = spark.createDataFrame([(1, DAY + timedelta(hours=a), DAY + timedelta(hours=b)) for a, b in [(1, 3), (2, 4), (3, 5), (6, 6), (6, 7)]], "site long, window_start timestamp, window_end timestamp")
    got = sorted((r.event_start.hour, r.event_end.hour) for r in R.merged(w).collect())
    assert got == [(1, 5), (6, 7)]


def test_sewage(spark):
    down, up = [7] * 2 + [1] * 3 + [7] * 4, [7] * 2 + [99] * 3 + [7] * 4
    s = series(spark, down, "dissolved_oxygen")
    for m, v in (("orp", down), ("turbidity", up), ("conductivity", up)):
        s = s.unionByName(series(spark, v, m))
    r = R.events(s).first()
    assert (r.type, r.confidence, r.severity, r.follow_up) == ("Sewage", 0.7, "Low", "Notify stakeholder")
    r = R.events(series(spark, up, "conductivity")).first()
    assert (r.type, r.confidence) == ("Inconclusive", 0.45)


def test_excursions_across_stretches(spark):
    """Runs that reach over the border of a stretch are one; samples within the baseline between stretches part them."""
    start = datetime(1970, 1, 1) + timedelta(milliseconds=R.STRETCH_MS * 10)
    hours = [(-3, 7.0), (-2, 1.0), (-1, 1.0), (1, 1.0), (2, 7.0), (3, 1.0), (5, 1.0), (24 * 29, 1.0), (24 * 31, 1.0), (24 * 61, 7.0), (24 * 91, 1.0), (24 * 92, 1.0)]
    cells = [(1, "ph", start + timedelta(hours=h), i, v, 6.5, 8.5) for i, (h, v) in enumerate(hours)]
    d = spark.createDataFrame(cells, "site long, metric string, at timestamp, ord long, value double, baseline_min double, baseline_max double")
    got = sorted(((r.window_start - start) / timedelta(hours=1), (r.window_end - start) / timedelta(hours=1)) for r in R.excursions(d).collect())
    assert got == [(-2, 1), (3, 24 * 31), (24 * 91, 24 * 92)]


def test_patterns(spark):
    out = series(spark, [7.2, 7.2, 5, 5, 5, 7.2])
    assert R.excursions(out.withColumn("pattern", F.lit("diel"))).isEmpty() and R.excursions(out.withColumn("pattern", F.lit("tidal"))).isEmpty()
    assert R.excursions(out.withColumn("pattern", F.lit("irregular"))).count() == 1
    swing = series(spark, [7.0, 4.5, 13.0, 7.5], "dissolved_oxygen", 6, 11, 5).withColumn("pattern", F.lit("diel"))
    r = R.events(swing).first()
    assert (r.type, r.confidence, r.severity, r.follow_up) == ("Algal bloom", 0.45, "Moderate", "Grab sample")
    assert R.status(R.parameters(series(spark, [7.2])), R.events(swing).select("site", "severity")).first().status == "Watch"
    steady = R.parameters(series(spark, [7.2]).withColumn("pattern", F.lit("tidal")))
    assert R.analysis_lines(steady).first().line == "Tracked the tidal cycle, remaining within the 6.5-8.5  site baseline."
    assert R.analysis_lines(R.parameters(series(spark, [7.2]))).isEmpty()


def test_no_baseline_counts_as_flagged(spark):
    """A temperature has no baseline, so its report has recommendations though its status is normal."""
    p = R.parameters(series(spark, [80.0], "temperature").withColumns({"baseline_min": F.lit(None).cast("double"), "baseline_max": F.lit(None).cast("double")}))
    none = spark.createDataFrame([], "site long, severity string")
    assert p.first().flag == "N/A" and R.status(p, none).first().status == "Normal"
    assert R.recommendations(p, none).first().operational.startswith("Recalibrate")
    assert R.analysis_lines(p).first().line.startswith("Showed no clearly classified pattern. No fixed baseline exists")
    assert R.summaries(p, none, "a to b").first().bullets[0] == "Overall status: Normal — no action required at this time."
    assert R.section_numbers([("a", True), ("b", False), ("c", True)]) == {"a": 1, "c": 2}


def test_bloom(spark):
    s = series(spark, [7.0, 4.5, 13.0, 7.5], "dissolved_oxygen", 6, 11, 5)
    p = spark.createDataFrame([(1, "dissolved_oxygen", "diel", 13.0, 11.0)], "site long, metric string, pattern string, max double, baseline_max double")
    assert R.blooms(s, p).first().confidence == 0.45
    more = p.unionByName(spark.createDataFrame([(1, "ph", "diel", 9.0, 8.5)], p.schema))
    assert R.blooms(s, more).first().confidence == 0.6
    assert R.blooms(s, p.withColumn("pattern", F.lit("unknown"))).isEmpty()


def test_flags_status_and_words(spark):
    p = R.parameters(series(spark, [7, 8.4]).unionByName(series(spark, [7, 99], "orp", 6, 11)).unionByName(series(spark, [5.98, 8], "dissolved_oxygen", 6, 11)))
    assert {r.metric: r.flag for r in p.collect()} == {"ph": "Normal", "orp": "Exceedance", "dissolved_oxygen": "Normal"}
    none = spark.createDataFrame([], "site long, severity string")
    assert R.status(p, none).first().status == "Action Required"
    assert "; moved sharply above baseline, recording an exceedance reading of 99.00 mV against the 6-11 mV baseline. First left baseline at 2026-08-01 00:30." in {r.metric: r.line for r in R.analysis_lines(p).collect()}["orp"]
    assert R.recommendations(p, none).first().stakeholder == "Notify client."


def test_decode(spark):
    docs = [
        {"data": {"device": "d", "timestamp": 1700000000, "lat": 0, "lon": 1, "best_lat": 41.5, "best_lon": -3.0, "water_data": {"lat": 12.0, "lon": 13.0, "99": "7.5", "98": 0, "97": "n/a", "102": 26.0, "phError": 1, "orpError": -1}}},
    ]
    got = {r.metric: r for r in G.decode(spark.createDataFrame([(json.dumps(d),) for d in docs], "body string"), unit="celsius").collect()}
    assert (got["ph"].value, got["ph"].valid) == (7.5, False) and (got["orp"].value, got["orp"].valid) == (0.0, True)
    assert got["dissolved_oxygen"].value is None and abs(got["temperature"].value - 78.8) < 1e-9 and got["turbidity"].value is None
    assert (got["ph"].lat, got["ph"].lon) == (41.5, -3.0)
    odd = spark.createDataFrame([(x,) for x in ("", " 1e3 ", "NaN", "Infinity", "1d", "0x10", "-.5")], "t string").select(fn.lenient_double(F.col("t")))
    assert [r[0] for r in odd.collect()] == [None, 1000.0, None, None, None, None, -0.5]


def test_devices(spark):
    d = spark.createDataFrame([("North Wetland Gate 2026", "dev:1", 0), ("Harbor East", "dev:2", 1), ("Harbor West", "dev:3", 2), ("Copy", "dev:1", 3), ("None", None, 4)], "name string, label string, ord int")
    once = G.first_by_label(d)
    assert sorted(r.name for r in once.collect()) == ["Harbor East", "Harbor West", "North Wetland Gate 2026"]
    assert G.resolve_one(once, "nwg") == "dev:1" and G.resolve_one(once, "dev:3") == "dev:3" and G.resolve_one(once, "", "harbor east") == "dev:2"
    with pytest.raises(LookupError, match="dev:2, dev:3"):
        G.resolve_one(once, "harbor")
    with pytest.raises(LookupError, match="no device"):
        G.resolve_one(once, "zz")
    tiers = spark.createDataFrame([("Algalita Pod", "dev:7"), ("Port Of Dover Inlet", "dev:8")], "name string, label string")
    assert [(r.label, r.tier) for r in G.matches(tiers, "pod").collect()] == [("dev:7", 4)]  # a part of a name comes before the start of initials
    assert [(r.label, r.tier) for r in G.matches(tiers, "po").collect()] == [("dev:8", 5)]
    assert G.matches(tiers, "dev:").isEmpty() and G.matches(tiers, "algalita  pod").isEmpty()
    assert [r.label for r in G.matching_any(tiers, ["DOVER", "x"]).collect()] == ["dev:8"] and G.matching_any(tiers, []).count() == 2


def test_last_reading_with_fix(spark):
    r = spark.createDataFrame([(1, "ph", DAY, 0, 7.0, True, 41.0, -3.0), (1, "ph", DAY + timedelta(hours=1), 1, 8.0, True, 0.0, 0.0), (1, "ph", DAY + timedelta(hours=2), 2, 9.0, True, None, None)], SAMPLE + ", lat double, lon double")
    assert G.latest_with_fix(r).first().value == 7.0 and G.latest(r).first().value == 9.0


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in V.cosine_top_k(v, [1.0, 0.0], 5).collect()] == [1, 2]
    assert [V.top_k(k) for k in (None, 0, -2, 3, 99)] == [5, 0, 0, 3, 10]
    d = spark.createDataFrame([(1, "Oxygen, oxygen!"), (2, "pH and oxygen"), (3, "none")], "doc_id long, text string")
    assert [r.doc_id for r in V.lexical_top_k(d, "What is the pH of oxygen?").collect()] == [2, 1]
    assert V.lexical_top_k(d, "what is the").isEmpty()
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("z", 1), ("y", 2)], "id string, rank int")
    got = [(r.id, round(r.score, 9)) for r in V.fuse([a, b], "id", 9).collect()]
    assert got == [("y", round(2 / 62, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 61, 9))]
    assert V.fuse([a, b], "id", 0).isEmpty()


def test_registry():
    r = V.Registry("one")
    r.register(type("A", (), {"name": "one"})())
    with pytest.raises(ValueError):
        r.register(type("A", (), {"name": "one"})())
    assert r.resolve("two").name == "one"


def test_corpus(spark):
    d = spark.createDataFrame([("a.md", None, "word " * 100, True), ("b.md", "B", "123 " * 100, False), ("c.md", "C", "tiny", True)], "filename string, title string, text string, in_slice boolean")
    got = C.ingested(d).collect()
    assert [(r.filename, r.title) for r in got] == [("a.md", "a.md")]
    assert C.ingested(d, structured=True).count() == 2
    assert C.new_only(d, d.limit(1)).count() == 2
    assert C.oversized(d).isEmpty()
    assert rows(C.summary(d.withColumn("chars", F.length("text"))))[0] == (3, 904, 504, 126)
    k = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    assert C.insert_new(k, k.filter("id = 2"), ["id"]).count() == 1


def test_costs(spark):
    c = E.request_costs(E.arms(spark))
    assert [r.total_usd for r in c.orderBy("ord").collect()] == pytest.approx([6.154e-4, 4.472e-4, 4.335e-4], abs=1e-7)
    b = {(r.a, r.b): r for r in E.break_even(c).collect()}
    assert b["direct", "hybrid"].kind == "crossover" and 35_000 < b["direct", "hybrid"].requests < 50_000
    assert b["hybrid", "vector"].kind == "dominated" and b["hybrid", "vector"].cheaper == "vector"
    with pytest.raises(Exception, match="more cached"):
        E.request_costs(E.arms(spark).withColumn("cached_tokens", F.lit(10**6))).collect()


def test_totals(spark):
    t = spark.createDataFrame([(1, 0, "user", 5, None, 1, None), (1, 1, "assistant", 7, None, 2, "x"), (1, 2, "user", 1, None, 1, None)], "conv_id int, turn int, role string, prompt_tokens long, cached_tokens long, completion_tokens long, error string")
    r = E.transcript_totals(t)
    assert rows(r)[0] == (1, 3, 13, None, 4, 1)
    s = E.sweep_summary(r).first()
    assert s.cache_hit_rate is None and s.warnings == "cache figures unreported; 1 turns failed"
    assert E.until_failure(t).count() == 2
    warm = E.sweep_summary(r.withColumns({"cached_tokens": F.lit(4).cast("long"), "empty_context": F.lit(1).cast("long")}), cold=True).first()
    assert warm.warnings == "4 prompt tokens of a cold pass came from the cache; 1 turns failed; a turn was answered with empty context"


def test_small_operators(spark):
    assert E.rotated({"x": ["a", "b", "c"], "y": ["d"], "z": ["e", "f"]}) == ["a", "d", "e", "b", "f", "c"]
    f = spark.createDataFrame([("b", [1, 2]), ("a", [1])], "id string, turns array<int>")
    assert rows(E.total_turns(f)) == [(2, 3)] and [r.id for r in E.stable_sample(f, "id", 1).collect()] == ["a"]
    e = spark.createDataFrame([(1, "status", 105, 100), (1, "token", 130, 100), (1, "token", 140, 100), (2, "done", 9, 5)], "id int, event string, at_ms long, begun_ms long")
    assert sorted(rows(E.first_token(e, "id"))) == [(1, 30), (2, None)]
    assert spark.range(1).select(E.vector_reads(F.lit(305), F.lit(5)), E.reads_usd(F.lit(9), 0.03)).first() == (9, 9 * 0.03 / 100_000)
    t = spark.createDataFrame([("vector",), (None,)], "mode string")
    with pytest.raises(ValueError, match="None"):
        E.foreign_arms(t, "vector")
    E.foreign_arms(t.filter("mode = 'vector'"), "vector")
    r = E.round_robin(spark.createDataFrame([(1, "x", 5), (2, "y", 1), (3, "x", 2)], "id int, g string, n int"), "g", F.col("n"), "id")
    assert [x.id for x in r.orderBy("round", "turn").collect()] == [3, 2, 1]
    assert [r.id for r in V.stub_feed(spark, [("a", "t", "s"), ("b", "t", "s")], 1).collect()] == ["a"]
    b = V.batches(spark.range(70).select(F.col("id"), F.lit("t").alias("text")).coalesce(1), "id").collect()
    assert sorted({(x.batch, x.place) for x in b}) == [(i // 32, i % 32) for i in range(70)] and b[0].text == "search_document: t"


def test_upserts(spark):
    old = spark.createDataFrame([("a b.md", "x"), ("c.md", "y")], "filename string, text string")
    new = spark.createDataFrame([("a_b.md", "z"), ("d.md", "w")], "filename string, text string")
    assert sorted(rows(C.upserted(old, new))) == [("a_b.md", "z"), ("c.md", "y"), ("d.md", "w")]
    d = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["x"] * 501), ("d", None), ("e", ["y"])], "filename string, chunks array<string>")
    assert sorted(r.filename for r in C.loadable(d, d.filter("filename = 'e'")).collect()) == ["a"]


def fleet(spark):
    return spark.createDataFrame([(1, "dev:1", "Harbor East", "salt marsh"), (2, "dev:2", "Harbor West", None)], "device long, label string, name string, environment string")


def test_sensor_query(spark):
    from weirflow.operators import sensor_query as Q

    s = made(spark, BASE)
    r = Q.ask(s, fleet(spark), Q.SensorQuestion("pH", "last 24 hours", "mean", "harbor e"), now=DAY + timedelta(days=1))[0]
    assert (round(r.value, 9), r.n_samples, r.unit, r.range_label, r.complete, r.range_end) == (6.9, 4, "unitless", "last 24 hours", True, DAY + timedelta(hours=15))
    assert r.note.startswith("This device operates in salt marsh, but the deployment's configured water type is freshwater.")
    r = Q.ask(s, fleet(spark), Q.SensorQuestion("all", "latest", "latest"), default_device="dev:2")
    assert len(r) == 6 and all(x.value is None and x.note.startswith("No readings found, and") for x in r)
    r = Q.ask(s, fleet(spark), Q.SensorQuestion("ph", "2026-07-01", "max", "dev:1"), water="saltwater", now=DAY, longest=timedelta(days=10))[0]
    assert (r.value, r.n_samples, r.complete) == (None, 0, False) and r.note == "No readings fall inside 2026-07-01T00:00:00.000Z to the end of the requested range. This device's most recent reading is 2026-08-01T15:00:00.000Z."
    raw = Q.ask(s, fleet(spark), Q.SensorQuestion("ph", "today", "raw", "dev:1"))[0]
    assert [x["value"] for x in raw.samples] == [6.0, 9.2, 7.4, 5.0] and raw.truncated is False and raw.value is None
    band = Q.ask(s, fleet(spark), Q.SensorQuestion("ph", "today", "series", "dev:1", "day"))[0]
    assert [(x["n"], x["min"]) for x in band.series] == [(4, 5.0)] and band.bucket_ms == 86_400_000
    for wrong, said in ((("salt", "today", "mean"), "Valid metrics"), (("ph", "soon", "mean"), "cannot read"), (("ph", "today", "mode"), "Valid aggregations"), (("ph", "today", "series", None, "eon"), "Valid buckets"), (("ph", "today", "mean", "harbor"), "several devices")):
        assert said in Q.ask_safely(s, fleet(spark), Q.SensorQuestion(*wrong))["error"]
    assert Q.ask_safely(s, fleet(spark), Q.SensorQuestion("ph", "today", "min", "dev:1"))["metrics"]["ph"]["value"] == 5.0
    for probe in Q.PROBES:
        Q.answers(s, fleet(spark), probe).schema


def test_fixture_errors(spark):
    from weirflow.sources.files import FIXTURE

    turn = lambda **x: {"role": "user", "content": "q", "rubric": {"must_contain": ["a"], "must_not": [], "cite": ["d1"], "notes": None}} | x
    good = {"filename": "f1.json", "id": "f1", "class": "c", "expected_to_favor": "tie", "answerable_from": ["d1"], "requires": [], "notes": "n", "turns": [turn(), turn()]}
    bad = good | {"filename": "f2.json", "id": "f3", "expected_to_favor": "rag", "turns": [turn(role="assistant", content=" ")]}
    d = spark.createDataFrame([good, bad], FIXTURE)
    got = E.fixture_errors(d, ["d1", "d2"], ["d1"], ["c"]).collect()
    assert {r.id for r in got} == {"f3"} and len(got) == 5


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(fn.bucket_start(F.lit(-1), F.lit(3_600_000))) == -3_600_000
    assert value(fn.coordinates(F.lit(-1.5), F.lit(2.25))) == "1.5000° S, 2.2500° E"
    assert value(fn.initials(F.lit("North Wetland Gate 2026"))) == "nwg"
    assert value(fn.chunk_id(F.lit("a b.md"), F.lit(12345))) == "a_b_md__12345"
    assert value(fn.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert value(fn.bearer(F.lit("Bearer  tok"))) == "tok" and value(fn.bearer(F.lit("Basic x"))) is None
    assert value(fn.empty_averages(F.array(F.lit(0.0), F.lit(0.0)))) is True and value(fn.empty_averages(F.array(F.lit(0.0), F.lit(None).cast("double")))) is False
    ages = {30_000: "just now", 90_000: "2 min ago", 59 * 60_000: "59 min ago", 89 * 60_000: "1 h ago", 90 * 60_000: "2 h ago", 47 * 3_600_000: "47 h ago", 48 * 3_600_000: "2 days ago"}
    assert {k: value(fn.age_label(F.lit(k))) for k in ages} == ages
    now = F.lit("2026-08-09T00:00:00Z").cast("timestamp")
    said = {None: "No readings on record", "": "No readings on record", "soon": "Last reading time unavailable", "2026-08-08T21:00:00.000Z": "Reporting · 3 h ago", "2026-08-07T10:00:00.000Z": "Silent since Aug 7"}
    assert {k: value(fn.freshness(F.lit(k).cast("string"), now)) for k in said} == said
    assert value(fn.mismatch(F.lit("salt marsh"), F.lit("freshwater"))) == "Salt marsh pod · thresholds are freshwater" and value(fn.mismatch(F.lit(None).cast("string"), F.lit("freshwater"))) is None
    assert [value(fn.plain_number(F.lit(x))) for x in (6.0, 6.5, 45000.0)] == ["6", "6.5", "45000"]
    assert [value(fn.metric_label(F.lit(x))) for x in ("dissolved_oxygen", "ph", "all", "")] == ["dissolved oxygen", "pH", "all metrics", None]
    assert [value(fn.asks_for_chart(F.lit(x))) for x in ("Plot pH", "how did it change over time?", "what is pH?")] == [True, True, False]
    assert value(fn.refuses(F.lit(" " + fn.REFUSAL + " Ask again."))) and not value(fn.refuses(F.lit("No.")))
    assert [value(fn.safe_filename(F.lit(x))) for x in ("report_1a.pdf", "../x.pdf", "x.txt")] == [True, False, False]
    assert [value(fn.tool_arguments(F.lit(x))) for x in ("", '{"a": 1}', "[1]", "{bad")] == [{}, {"a": "1"}, None, None]
    shown = lambda v, ok: value(fn.metric_display(F.lit("pH"), F.lit(v).cast("double"), F.lit(None).cast("string"), F.lit(ok), F.lit("phError")))
    assert [shown(7.5, True), shown(7.0, False), shown(None, True)] == ["pH: 7.5", "pH: 7  [!] phError set", "pH: —"]
    assert value(fn.midpoint(F.lit(10), F.lit(20))) == 15.0 and value(fn.midpoint(F.lit(10), F.lit(10))) == 10.0
    assert value(fn.truncated(F.lit("abcdef"), 3)) == "abc" and value(fn.date_slice(F.lit("2026-08-07T23:59:59Z"))) == "2026-08-07"
    assert value(fn.strict_date(F.lit("2026-02-30"))) is None
    assert D.metric_key(" DO ") == "dissolved_oxygen" and D.metric_key("All") == "all"
    for wrong in ("salt", "redox", "temp", "Dissolved oxygen", "Conductivity "[:-1] + "x"):
        with pytest.raises(ValueError, match="Valid metrics"):
            D.metric_key(wrong)
    assert {r.metric: r.range for r in D.operator_ranges(spark, "saltwater").collect()}["conductivity"] == "40,000 to 50,000 µS/cm"


def test_vectors_of_batches(spark):
    """By index and not by the order they come in; a batch with anything wrong has no vector at all."""
    texts = spark.createDataFrame([(b, p, f"{b}.{p}") for b in range(6) for p in range(3)], "batch long, place int, text string")
    one = lambda x: [float(x), 1.0]
    items = [(0, 9, one(9)), (0, 4, one(4)), (0, 7, one(7)), (1, 0, one(0)), (1, 1, one(1)), (2, 0, one(0)), (2, 1, [1.0]), (2, 2, [0.0, 0.0])]
    items += [(3, 0, one(0)), (3, 1, [0.0, 0.0]), (3, 2, one(2)), (4, 0, one(0)), (4, 1, None), (4, 2, one(2))]
    got = V.with_vectors(texts, spark.createDataFrame(items, "batch long, index int, embedding array<double>"), 2).collect()
    assert {r.text: r.embedding for r in got if r.batch == 0} == {"0.0": one(4), "0.1": one(7), "0.2": one(9)}
    assert len(got) == 18 and all(r.embedding is None for r in got if r.batch)
    assert {r.batch: r.error for r in got} == {
        0: None, 1: "Embedding API returned 2 vectors for 3 inputs.", 2: "returned 1 dimensions; the schema expects 2.", 3: "returned an all-zero vector for input 1.",
        4: "returned 0 dimensions; the schema expects 2.", 5: "Embedding API returned 0 vectors for 3 inputs.",
    }


def test_notice_of_a_failed_query(spark):
    from weirflow.operators import sensor_query

    shape = "last_reported timestamp, n_samples long, complete boolean, covered_from timestamp, range_start timestamp, metric string, note string, error string"
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, "no device"), (None, 0, True, None, None, "ph", "", None)], shape)
    got = [r.notices for r in sensor_query.notices(rows, F.lit("2026-01-01").cast("timestamp")).collect()]
    assert got == [["Sensor query failed — no device"], ["No readings in this window · no last reading on record for this pod"]]
