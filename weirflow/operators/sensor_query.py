"""One call from a question about sensors (metric, aggregation, time phrase, device) to its answer, for a whole fleet or one device.

`answers` is the plan: one scan of the samples, a row for each device and metric asked for. `ask` picks one device and
raises; `ask_safely` gives errors as data. `notices` are what a reader must know about an answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weirflow.functions import timephrase
from weirflow.functions.scalars import age_label, date_slice, epoch_ms, iso_instant, water_kind
from weirflow.operators import registry
from weirflow.operators import samples as S
from weirflow.operators.dimensions import METRICS, metric_key

# The wording of notes and notices, the age from which a device counts as silent, and a unit for metrics without one.
UNITLESS = "unitless"
SILENT_MS = 86_400_000
PROVISIONAL = "Turbidity is derived from a raw voltage by a provisional, uncalibrated conversion. It is a relative index expressed in NTU, not a calibrated measurement."
LONGEST_REASON = "The device API's longest window is one year."


class QueryError(ValueError):
    """A question that cannot be answered as it was asked."""


@dataclass(frozen=True)
class SensorQuestion:
    metric: str
    time_range: str
    aggregation: str
    device: str | None = None
    bucket: str | None = None

    def checked(self) -> tuple[list[str], str, str]:
        """Metrics, aggregation and bucket by their keys. Raises QueryError with all that would be accepted."""
        try:
            metric = metric_key(self.metric)
            timephrase.parse(self.time_range)
        except ValueError as e:
            raise QueryError(str(e)) from e
        name, bucket = self.aggregation.strip().lower(), (self.bucket or "auto").strip().lower()
        if name not in S.AGGREGATIONS:
            raise QueryError(f'Unknown aggregation "{self.aggregation}". Valid aggregations: {", ".join(S.AGGREGATIONS)}.')
        if bucket != "auto" and bucket not in S.WIDTHS:
            raise QueryError(f'Unknown bucket "{self.bucket}". Valid buckets: {", ".join(("auto", *S.WIDTHS))}.')
        return [k for k, *_ in METRICS] if metric == "all" else [metric], name, bucket


def covered_from(start: Column, now: Column, longest: timedelta | None) -> Column:
    """From when on a window was searched: its start, or where the longest look-back before ``now`` begins; without one all history is."""
    return start if longest is None else F.greatest(start, now - F.make_dt_interval(secs=F.lit(longest.total_seconds())))


def empty_note(n: Column, start: Column, newest: Column) -> Column:
    return F.when(n == 0, F.concat(F.lit("No readings fall inside "), iso_instant(start), F.lit(" to the end of the requested range. This device's most recent reading is "), iso_instant(newest), F.lit(".")))


def water_note(environment: Column, deployment: str) -> Column:
    """That a device's water is not what the deployment's ranges are written for. Salt is looked for as it is written."""
    own = F.when(environment.contains("salt"), "saltwater").otherwise("freshwater")
    text = F.concat(
        F.lit("This device operates in "), environment, F.lit(f", but the deployment's configured water type is {deployment}. The normal ranges in your instructions are for {deployment}; say so if you compare this reading against them."),
    )
    return F.when(environment.isNotNull() & (environment != "") & (own != deployment), text)


def answers(samples: DataFrame, devices: DataFrame, question: SensorQuestion, water: str = "freshwater", now: datetime | None = None, longest: timedelta | None = None) -> DataFrame:
    """A row for each device of ``devices`` (label, name, environment, device) and metric asked for.

    label, metric, unit, aggregation, value (null for raw and series), n_samples, excluded_faulted, observed_at, samples (raw: at and value,
    oldest first), series (buckets, oldest first), bucket_ms, truncated, range_start, range_end, range_label, covered_from, complete, last_reported, note.
    A device without readings has null times; a group without samples has a null value and counts of zero.
    """
    metrics, name, bucket = question.checked()
    parsed = timephrase.parse(question.time_range)
    own = samples.filter(F.col("metric").isin(*metrics)) if len(metrics) < len(METRICS) else samples
    window = S.in_window(samples, question.time_range).filter(F.col("metric").isin(*metrics)) if own is not samples else S.in_window(samples, question.time_range)
    key = ["device", "metric"]
    null = lambda kind: F.lit(None).cast(kind)
    point, band = "array<struct<at: timestamp, value: double>>", "array<struct<start_ms: bigint, end_ms: bigint, mean: double, min: double, max: double, n: bigint>>"
    counted = window.filter("value IS NOT NULL").groupBy(*key).agg(*S.counts())
    if name == "raw":
        kept = S.raw(window).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "ord", "value"))).alias("s"), F.max("truncated").alias("truncated"))  # at most as many as the cap
        made = counted.join(kept, key, "left").select(*key, "n_samples", "excluded_faulted", null("double").alias("value"), null("timestamp").alias("observed_at"), F.transform("s", lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value"))).alias("samples"), null(band).alias("series"), null("bigint").alias("bucket_ms"), "truncated")
    elif name == "series":
        b = S.series(window, bucket).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "mean", "min", "max", "n"))).alias("series"), F.max("width_ms").alias("bucket_ms"))  # likewise
        made = counted.join(b, key, "left").select(*key, "n_samples", "excluded_faulted", null("double").alias("value"), null("timestamp").alias("observed_at"), null(point).alias("samples"), "series", "bucket_ms", null("boolean").alias("truncated"))
    else:
        a = S.aggregate(window, name)
        seen = F.col("observed_at") if "observed_at" in a.columns else null("timestamp")
        made = a.select(*key, "n_samples", "excluded_faulted", "value", seen.alias("observed_at"), null(point).alias("samples"), null(band).alias("series"), null("bigint").alias("bucket_ms"), null("boolean").alias("truncated"))
    start, end, _ = S.window_columns(question.time_range)
    clock = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    asked = devices.select("device", "label", "environment", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    rows = S.on_spine(made, asked).join(S.anchors(samples), "device", "left")
    units = F.create_map(*[F.lit(x) for k, _, _, unit, _ in METRICS for x in (k, unit or UNITLESS)])
    known = F.col("anchor").isNotNull()
    rows = rows.withColumns({"range_start": F.when(known, start.cast("timestamp")), "range_end": F.when(known, end.cast("timestamp"))})
    total = F.sum("n_samples").over(S.Window.partitionBy("device"))  # as many rows as metrics
    notes = F.concat_ws(" ", empty_note(total, F.col("range_start"), F.col("anchor")), F.lit(PROVISIONAL) if "turbidity" in metrics else null("string"), water_note(F.col("environment"), water))
    covered = covered_from(F.col("range_start"), clock, longest)
    note = F.when(~known, "No readings found, and the device API has no last reading for this device either.").otherwise(F.nullif(notes, F.lit("")))
    return rows.select(
        "device", "label", "metric", F.element_at(units, F.col("metric")).alias("unit"), F.lit(name).alias("aggregation"), "value", "n_samples", "excluded_faulted", "observed_at", "samples", "series", "bucket_ms", "truncated",
        "range_start", "range_end", F.when(known, parsed.label).alias("range_label"), covered.alias("covered_from"), (covered == F.col("range_start")).alias("complete"), F.col("anchor").alias("last_reported"), note.alias("note"),
    )


def ask(samples: DataFrame, devices: DataFrame, question: SensorQuestion, default_device: str | None = None, **options) -> list[Row]:
    """The answer for one device: a row for each metric. The question's device wins over the default one. Raises QueryError."""
    question.checked()
    try:
        label = registry.resolve_one(devices.filter("label IS NOT NULL"), question.device, default_device)
    except LookupError as e:
        raise QueryError(str(e)) from e
    one = devices.filter(F.col("label") == label).limit(1)
    ids = [r.device for r in one.select("device").collect()]
    return answers(samples.filter(F.col("device").isin(*ids)), one, question, **options).orderBy("metric").collect()


def ask_safely(samples: DataFrame, devices: DataFrame, question: SensorQuestion, default_device: str | None = None, **options) -> dict:
    """`ask` with errors as data, for callers that must go on."""
    try:
        return {"metrics": {r.metric: r.asDict(recursive=True) for r in ask(samples, devices, question, default_device, **options)}}
    except QueryError as e:
        return {"error": str(e)}


def notices(found: DataFrame, now: Column) -> DataFrame:
    """The answers with ``notices``: an empty window, a window anchored long ago, a search that fell short, provisional turbidity. Their wording is fixed.

    If the answers have an ``error``, a query that failed has the notice of that alone.
    """
    last = iso_instant(F.col("last_reported"))
    age = epoch_ms(now) - epoch_ms(F.col("last_reported"))
    stale = age > SILENT_MS
    empty = F.when(F.col("last_reported").isNull(), "No readings in this window · no last reading on record for this pod").when(stale, F.concat(F.lit("No readings in this window · pod silent since "), date_slice(last))).otherwise(
        F.concat(F.lit("No readings in this window · pod last reported "), age_label(age))
    )
    anchored = F.when(stale, F.concat(F.lit("Window anchored to the pod's last reading, "), date_slice(last), F.lit(" — not to today")))
    short = F.when(~F.col("complete"), F.concat(F.lit("Search did not reach that far back — covered "), date_slice(iso_instant(F.col("covered_from"))), F.lit(" onward, not "), date_slice(iso_instant(F.col("range_start")))))
    turbidity = F.when((F.col("metric") == "turbidity") & F.col("note").contains("provisional, uncalibrated"), "Turbidity provisional — a relative index, not a calibrated measurement")
    all_of_them = F.array_compact(F.array(F.when(F.col("n_samples") == 0, empty).otherwise(anchored), short, turbidity))
    if "error" not in found.columns:
        return found.withColumn("notices", all_of_them)
    failed = F.array(F.concat(F.lit("Sensor query failed — "), F.col("error")))
    return found.withColumn("notices", F.when(F.col("error").isNotNull(), failed).otherwise(all_of_them))


def device_kinds(devices: DataFrame) -> DataFrame:
    """Devices with the kind of their water, null where it is not known."""
    return devices.withColumn("water", water_kind(F.col("environment")))


#: The questions with which a fleet is tried out: each aggregation once, over windows of every kind.
PROBES = [
    SensorQuestion("do", "latest", "latest"), SensorQuestion("ph", "last 24 hours", "mean"), SensorQuestion("conductivity", "last week", "max"), SensorQuestion("turbidity", "today", "min"),
    SensorQuestion("all", "last 7 days", "median"), SensorQuestion("orp", "last 30 days", "series"),
]
