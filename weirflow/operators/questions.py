"""A whole table of questions about sensors answered in one plan.

Each row asks for a metric (or all), an aggregation, a time phrase and a device by any of its names. Phrases and
names are read by expressions and one join, windows are resolved against each device's newest reading, and samples
meet windows by device, metric and time bin. Errors are data: a question that cannot be answered is a row that says
why, in the words that `sensor_query` uses. Questions that were read are written to the shared folder, since each kind of
answer (statistics, medians, raw samples, series) takes its own from them; samples are shuffled once for all kinds.
Questions meet devices and samples in sorted parts: their file is small for its rows, and would be sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import timephrase
from weirflow.functions.scalars import bucket_start, epoch_ms
from weirflow.operators import samples as S
from weirflow.operators.dimensions import ALIASES, METRICS
from weirflow.operators.intervals import within
from weirflow.operators.registry import matches_of
from weirflow.sources.durable import written

#: Width of the bins in which samples and windows meet.
BIN_MS = 7 * 86_400_000
_POINT, _BAND = "array<struct<at:timestamp,value:double>>", "array<struct<start_ms:bigint,end_ms:bigint,mean:double,min:double,max:double,n:bigint>>"


def _known(names: dict[str, object], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def checked(questions: DataFrame) -> DataFrame:
    """Questions with metrics (keys), name (of the aggregation), width (of buckets, null for automatic ones), window (parsed), and error: what the question cannot be asked for."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    keys = [k for k, *_ in METRICS]
    key = _known({k: k for k in keys} | ALIASES | {"all": "all"}, low("metric"))
    metrics = F.when(key == "all", F.array(*[F.lit(k) for k in keys])).otherwise(F.array(key))
    bucket = F.coalesce(F.nullif(F.lower(F.trim("bucket")), F.lit("")), F.lit("auto")) if "bucket" in questions.columns else F.lit("auto")
    shown = F.col("bucket") if "bucket" in questions.columns else F.lit(None).cast("string")
    window = timephrase.parsed(F.col("time_range"))
    text = lambda c: F.coalesce(c, F.lit(""))
    error = (
        F.when(key.isNull(), F.concat(F.lit('Unknown metric "'), text(F.col("metric")), F.lit(f'". Valid metrics: {", ".join(keys)}, all.')))
        .when(window.isNull() & (F.trim(F.regexp_replace(text(F.col("time_range")), r"(?U)[\s\x1c-\x1f]+", " ")) == ""), "a time range is required")
        .when(window.isNull(), F.concat(F.lit("cannot read '"), F.col("time_range"), F.lit("': use latest, today, yesterday, this week, last N hours/days/weeks/months/years, a date, or one date to another")))
        .when(~F.coalesce(low("aggregation").isin(*S.AGGREGATIONS), F.lit(False)), F.concat(F.lit('Unknown aggregation "'), text(F.col("aggregation")), F.lit(f'". Valid aggregations: {", ".join(S.AGGREGATIONS)}.')))
        .when(~bucket.isin("auto", *S.WIDTHS), F.concat(F.lit('Unknown bucket "'), shown, F.lit(f'". Valid buckets: {", ".join(("auto", *S.WIDTHS))}.')))
    )
    return questions.select("question", "device", metrics.alias("metrics"), low("aggregation").alias("name"), _known(S.WIDTHS, bucket).alias("width"), window.alias("window"), error.alias("error"))


def resolved_devices(asked: DataFrame, devices: DataFrame, default_device: str | None = None) -> DataFrame:
    """Checked questions with the id and label of the one device they name; for none, and for several, an error that lists up to ten."""
    plain = F.regexp_replace(F.coalesce(F.col("device"), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    q = asked.withColumn("said", F.when(plain != "", plain).otherwise((default_device or "").strip())).withColumn("asked", F.lower("said")).drop("device")
    labelled = devices.filter("label IS NOT NULL").select("device", "label", "name")
    found = matches_of(q.filter("asked <> ''").select("asked"), labelled).select("asked", "label", "device")
    nobody = q.filter("asked = ''").select("asked").distinct().join(labelled.select("label", "device"), how="cross") if not default_device else found.filter("false")  # one row of questions that name no device
    per = found.unionByName(nobody.select("asked", "label", "device")).groupBy("asked", "label").agg(F.min("device").alias("device"))
    order = Window.partitionBy("asked").orderBy("label")
    first = per.withColumn("place", F.row_number().over(order)).filter("place <= 11").groupBy("asked").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.min_by("device", "label").alias("device"))
    listed = F.array_join(F.slice("labels", 1, 10), ", ")
    said = F.concat(F.lit("'"), F.col("said"), F.lit("': "))
    wrong = F.when(F.col("labels").isNull(), F.concat(F.lit("no device for "), said)).when(F.size("labels") > 1, F.concat(F.lit("several devices for "), said, listed))
    joined = q.join(first.hint("merge"), "asked", "left").withColumn("error", F.coalesce("error", wrong))
    return joined.select("question", F.when(F.col("error").isNull(), F.col("device")).alias("device"), F.when(F.col("error").isNull(), F.element_at("labels", 1)).alias("label"), "metrics", "name", "width", "window", "error")


def answers(questions: DataFrame, samples: DataFrame, devices: DataFrame, default_device: str | None = None) -> DataFrame:
    """A row for each question and metric: question, device, label, metric, aggregation, value (null for raw and series), n_samples, excluded_faulted, observed_at, samples, series, bucket_ms, truncated, range_start, range_end, range_label, last_reported, error.

    ``questions``: question (its id), device, metric, aggregation, time_range, and a bucket if there is one. A question with an
    error is one row with null results; a device without readings has null times; a group without samples has a null
    value and counts of zero. Rows that repeat a question's id are one question that is asked twice: ids should be distinct.
    """
    q = written(resolved_devices(checked(questions), devices, default_device), "questions")  # read by every kind of answer
    spans = samples.groupBy("device").agg(F.max("at").alias("anchor"), F.min("at").alias("oldest"))
    asked = q.filter("error IS NULL").join(spans.hint("merge"), "device", "left").withColumn("r", timephrase.resolved(F.col("window"), F.col("anchor"))).withColumn("metric", F.explode("metrics"))
    asked = asked.select("question", "device", "label", "metric", "name", "width", "anchor", "oldest", "r.start", "r.end", F.col("r.label").alias("range_label"), "r.end_inclusive")
    # Windows are cut to what there is of a device, so that long ones take no more bins than its history.
    windows = asked.filter("anchor IS NOT NULL").select(
        "question", "device", "metric", "name", "width", F.greatest("start", "oldest").alias("from"), F.least("end", F.col("anchor") + F.expr("interval 1 second")).alias("to"), (F.col("end_inclusive") | (F.col("end") > F.col("anchor"))).alias("closed")
    )
    inside = within(samples.filter("value IS NOT NULL"), windows, ["device", "metric"], "from", "to", width_ms=BIN_MS, end_inclusive="closed")
    key, ok = ["question", "metric"], F.col("valid")
    only = lambda name: F.when(ok & (F.col("name") == name), F.col("value"))
    newest = lambda name: F.when(ok & (F.col("name") == name), F.struct("at", "ord"))
    scalar = {"min": F.min(only("min")), "max": F.max(only("max")), "mean": F.avg(only("mean")), "latest": F.max_by("value", newest("latest")), "earliest": F.min_by("value", newest("earliest"))}
    seen = {"latest": F.max(F.when(ok & (F.col("name") == "latest"), F.col("at"))), "earliest": F.min(F.when(ok & (F.col("name") == "earliest"), F.col("at")))}
    base = inside.groupBy(*key).agg(F.coalesce(*scalar.values()).alias("value"), *S.counts(), F.coalesce(*seen.values()).alias("observed_at"))
    middle = S.medians(inside.filter("name = 'median'"), tuple(key)).withColumnRenamed("value", "median")
    kept = S.raw(inside.filter("name = 'raw'"), by=tuple(key)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "ord", "value"))).alias("s"), F.max("truncated").alias("truncated"))  # as many as the cap
    kept = kept.select(*key, F.transform("s", lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))).cast(_POINT).alias("samples"), "truncated")
    band = _series(inside.filter("name = 'series' AND valid"), tuple(key)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "mean", "min", "max", "n"))).cast(_BAND).alias("series"), F.max("width_ms").alias("bucket_ms"))
    made = base.join(middle, key, "left").join(kept, key, "left").join(band, key, "left").withColumn("value", F.coalesce("value", "median")).drop("median")
    rows = S.on_spine(made, asked, tuple(key))
    known = F.col("anchor").isNotNull()
    good = rows.select(
        "question", "device", "label", "metric", F.col("name").alias("aggregation"), "value", "n_samples", "excluded_faulted", "observed_at", "samples", "series", "bucket_ms", "truncated",
        F.when(known, F.col("start")).alias("range_start"), F.when(known, F.col("end")).alias("range_end"), F.when(known, F.col("range_label")).alias("range_label"), F.col("anchor").alias("last_reported"), F.lit(None).cast("string").alias("error"),
    )
    empty = {f.name: f.dataType for f in good.schema.fields}
    bad = q.filter("error IS NOT NULL").select("question", *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items() if c not in ("question", "error")], "error")
    return good.unionByName(bad)


def _series(s: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Buckets of the width that a question names, or of one from the ladder."""
    s = s.withColumn("ms", epoch_ms(F.col("at")))
    spans = s.groupBy(*by).agg((F.max("ms") - F.min("ms")).alias("span"), F.max("width").alias("named"))
    s = s.join(spans.select(*by, F.coalesce("named", S.auto_width(F.col("span"))).alias("width_ms")), list(by))
    return S._buckets(s.withColumn("start_ms", bucket_start(F.col("ms"), F.col("width_ms"))), by, S.MAX_BUCKETS)
