import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.operators import report
from weirflow.operators import samples as S
from weirflow.sources import files
from weirflow.streaming import samples as streams

DAY = datetime(2026, 8, 1)


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture()
def stream(spark, tmp_path):
    cells = [(d, "ph", DAY + timedelta(minutes=17 * i), i, float(i), i % 5 > 0, 3.0, 50.0) for d in (1, 2) for i in range(60)]
    df = spark.createDataFrame(cells, "device long, metric string, at timestamp, ord long, value double, valid boolean, baseline_min double, baseline_max double")
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_tumbling_equals_batch(stream):
    batch, live = stream
    want = {(r.device, r.start_ms): (r.n, round(r["mean"], 9)) for r in S.series(batch, "hour").collect()}
    got = drained(streams.tumbling(live), "complete", "tumbling").collect()
    assert {(r.device, int((r.start - datetime(1970, 1, 1)).total_seconds() * 1000)): (r.n, round(r["mean"], 9)) for r in got} == want


def test_distinct_and_freshness(spark, stream):
    batch, live = stream
    assert drained(streams.distinct(live), "append", "once").count() == batch.count()
    last = {r.device: (r.last_at, r.readings) for r in drained(streams.freshness(live), "update", "fresh").collect()}
    assert last == {d: (DAY + timedelta(minutes=17 * 59), 60) for d in (1, 2)}


def test_sessions(spark, stream):
    _, live = stream
    s = live.withColumnRenamed("device", "site")
    got = drained(streams.excursion_sessions(s), "append", "sessions")
    assert set(got.columns) == {"site", "metric", "window_start", "window_end", "n"}


def test_runs_equal_batch(spark, tmp_path):
    """Over several files that come out of order within the watermark, with gaps of days inside runs, the stream's last word is the batch's."""
    r = random.Random(3)
    cells = []
    for site in (1, 2, 3):
        at, state = DAY, False
        for n in range(160):
            at += timedelta(minutes=r.choice((0, 7, 20, 20, 45, 45)) if n % 50 else 60 * 60)
            state = state if r.random() < 0.8 else not state
            cells.append((site, "ph", at, n, None if n % 41 == 40 else 9.0 if state else 7.0, 6.5, 8.5, "tidal" if site == 3 else "flat"))
    shape = "site long, metric string, at timestamp, ord long, value double, baseline_min double, baseline_max double, pattern string"
    cells.sort(key=lambda c: (c[2], c[0]))
    whole = spark.createDataFrame(cells, shape)
    for part in range(0, len(cells), 60):
        own = cells[part : part + 60]
        r.shuffle(own)
        spark.createDataFrame(own, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = drained(streams.excursion_runs(live, "4 hours"), "update", "runs").collect()
    finally:
        spark.conf.unset(provider)
    ends = {}
    for x in rows:
        key = (x.site, x.window_start)
        ends[key] = max(ends.get(key, (x.window_end, x.ended)), (x.window_end, x.ended))
    passed = max(c[2] for c in cells) - timedelta(hours=4)
    want = {(w.site, w.window_start): w.window_end for w in report.excursions(whole.filter(F.col("at") <= F.lit(passed))).collect()}
    assert {k: e for k, (e, _) in ends.items()} == want and len(want) > 5
    assert any(e - s > timedelta(hours=30) for (_, s), e in want.items()) and {3} & {k[0] for k in want} == set()


def test_clean_text(spark, tmp_path):
    rows = [(1, i, p, i == 3) for i, p in enumerate(["data: a 【comm\n\n", "data: entary x】 b\n", "\ndata: c\n\n", ""])]
    df = spark.createDataFrame(rows, "conv_id long, ord long, piece string, last boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    assert "".join(r.text for r in drained(streams.clean_text(live), "append", "cleaned").collect()) == "a bc"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    (tmp_path / "c.bin").write_text("no")
    assert {r.filename: r.text for r in files.text_files(spark, str(tmp_path)).collect()} == {"a.md": "one\ntwo", "b.txt": "three"}
    assert files.text_files(spark, str(tmp_path), exclude=("a.md",)).count() == 1
    (tmp_path / "s.csv").write_text("DEVICE,DATE,DISSOLVED OXYGEN,ORP,PH,CONDUCTIVITY,TEMPERATURE\nd,13:05 02/28/2026,7.5,NA,,x,9\nd,bad,1,2,3,4,5\n")
    r, bad = files.sensor_csv(spark, str(tmp_path / "s.csv")).collect()
    assert (r.measured_at, r.dissolved_oxygen, r.orp, r.ph, r.conductivity, r.temperature) == (datetime(2026, 2, 28, 13, 5), 7.5, None, None, None, 9.0)
    assert bad.measured_at is None


def test_corpus_files(spark, tmp_path):
    d = spark.createDataFrame([("a", "A", None, "t", True), ("b", "B", None, "u", False)], "filename string, title string, source_url string, text string, in_slice boolean")
    path = str(tmp_path / "corpus")
    files.upsert_corpus(d, path)
    assert [r.filename for r in files.slice_source(spark, "store", path).collect()] == ["a"]
    with pytest.raises(ValueError):
        files.slice_source(spark, "cloud", path)
    with pytest.raises(ValueError, match="nothing was written"):
        files.upsert_corpus(d.selectExpr("filename", "repeat('x', 1000000) AS text"), path)
    more = spark.createDataFrame([("b", "B2", None, "v", True), ("c", "C", None, "w", True)], d.schema)
    files.upsert_corpus(more, path)
    assert sorted((r.filename, r.title) for r in spark.read.parquet(path).collect()) == [("a", "A"), ("b", "B2"), ("c", "C")]
    c = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", "B", []), ("c", "C", ["z"] * 501)], "filename string, title string, chunks array<string>")
    assert sorted(r.filename for r in files.load_chunks(c, str(tmp_path / "chunks")).collect()) == ["b", "c"]
    files.load_chunks(c, str(tmp_path / "chunks"))
    assert [(r.filename, r.chunk_index, r.text) for r in spark.read.parquet(str(tmp_path / "chunks")).orderBy("chunk_index").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    assert [files.http_error(s).code for s in (401, 404, 503, None)] == ["unauthorised", "rejected", "unavailable", "unavailable"]
    assert files.http_error(None, True).code == "timeout"
    t = spark.createDataFrame([("f", "c", "vector", "warm", [])], files.TRANSCRIPT)
    files.write_transcripts(t, str(tmp_path / "tr"))
    found = files.transcripts(spark, str(tmp_path / "tr"))
    assert found.filter("arm = 'vector'").count() == 1
    asked = spark.createDataFrame([("warm", "vector", "f"), ("warm", "direct", "f")], "pass string, arm string, fixtureId string")
    assert {(r.arm, r.turns is None) for r in files.transcripts_of(asked, found).collect()} == {("vector", False), ("direct", True)}


def test_fixture_files(spark, tmp_path):
    turn = {"role": "user", "content": "q", "rubric": {"must_contain": ["a"], "must_not": [], "cite": None, "notes": None}}
    good = {"id": "f1", "class": "c", "expected_to_favor": "tie", "answerable_from": ["d1"], "requires": [], "notes": "n", "turns": [turn, turn]}
    (tmp_path / "f1.json").write_text(json.dumps(good))
    assert files.valid_fixtures(spark, str(tmp_path), ["d1"], ["d1"], ["c"]).count() == 1
    sheet = files.score_sheet(files.fixtures(spark, str(tmp_path)), ["A", "B"])
    assert [(r.turn, r.label) for r in sheet.collect()] == [(0, "A"), (0, "B"), (1, "A"), (1, "B")]
    (tmp_path / "f2.json").write_text(json.dumps(good | {"class": "x", "notes": " "}))
    with pytest.raises(ValueError, match="(?s)f1: .*f1: "):
        files.valid_fixtures(spark, str(tmp_path), ["d1"], ["d1"], ["c"])
    files.write_prompts(spark.createDataFrame([("c", "q?")], "class string, prompt string"), str(tmp_path / "prompts"))
    assert spark.read.json(str(tmp_path / "prompts")).first().prompt == "q?"
