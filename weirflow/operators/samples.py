"""Statistics over samples (device, metric, at, ord, value, valid): windows anchored at each device's newest
reading, eight aggregations that leave faulted readings out, and bucketed series.

No data is null with a count of zero, never a zero; zero is a value like any other; of equal times the
greater ``ord`` is the newer. All are one scan and one shuffle on (device, metric).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import timephrase
from weirflow.functions.scalars import bucket_start, epoch_ms, midpoint

HOUR_MS = 3_600_000
# Bucket widths from which an automatic one is taken, in hours, and the caps of a result.
LADDER_HOURS = (1, 2, 3, 6, 12, 24, 48, 168, 720)
MAX_BUCKETS, RAW_LIMIT = 60, 200
WIDTHS = {"hour": HOUR_MS, "day": 24 * HOUR_MS, "week": 168 * HOUR_MS}
AGGREGATIONS = ("min", "max", "mean", "median", "latest", "earliest", "raw", "series")


def from_events(events: DataFrame) -> DataFrame:
    """Bind a table of events: device is the user, metric the type; a reading is faulted where its property k is 90 or more."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.col("user_id").alias("device"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"),
        F.col("value").cast("double").alias("value"), F.coalesce(k < 90, F.lit(True)).alias("valid"),
    )


def anchors(samples: DataFrame) -> DataFrame:
    """Each device's newest reading, over all its metrics and whether valid or not."""
    return samples.groupBy("device").agg(F.max("at").alias("anchor"))


def window_columns(phrase: str) -> tuple[Column, Column, bool]:
    """Start, end and whether the end is included, as columns over ``anchor``."""
    p = timephrase.parse(phrase)
    a = F.col("anchor")
    if p.kind == "latest":
        return a, a, True
    if p.kind == "rolling":
        return a - F.make_dt_interval(secs=F.lit(p.span.total_seconds())), a, True
    if p.kind == "absolute":
        return F.lit(p.start), F.lit(p.end), False
    days = timephrase.SPANS[p.unit].days
    start = F.date_trunc(p.unit, a) + F.make_dt_interval(days=F.lit(p.offset * days))
    return start, start + F.make_dt_interval(days=F.lit(days)), False


def in_window(samples: DataFrame, phrase: str, devices: list | None = None) -> DataFrame:
    """The samples in each device's own window.

    An absolute window, and a set of devices, are pushed-down filters. Relative windows join each device's anchor,
    one row per device, which AQE broadcasts where it turns out to be small; the range is the residual condition.
    Nothing runs while the plan is built.
    """
    if devices is not None:
        samples = samples.filter(F.col("device").isin(*devices))
    p = timephrase.parse(phrase)
    if p.kind == "absolute":
        return samples.filter((F.col("at") >= F.lit(p.start)) & (F.col("at") < F.lit(p.end)))
    start, end, inclusive = window_columns(phrase)
    upper = F.col("at") <= end if inclusive else F.col("at") < end
    return samples.join(anchors(samples), "device").filter((F.col("at") >= start) & upper).drop("anchor")


def _ok(c: str) -> Column:
    return F.when(F.col("valid"), F.col(c))


def _newest() -> Column:
    return F.when(F.col("valid"), F.struct("at", "ord"))


def statistic(name: str) -> Column:
    """min, max, mean, median, latest or earliest over the valid samples of a group."""
    pair = F.when(F.col("valid"), F.col("value"))
    made = {
        "min": F.min(pair), "max": F.max(pair), "mean": F.avg(pair), "median": F.percentile(pair, 0.5),
        "latest": F.max_by(F.col("value"), _newest()), "earliest": F.min_by(F.col("value"), _newest()),
    }
    if name not in made:
        raise ValueError(f"unknown aggregation {name!r}: one of {', '.join(AGGREGATIONS)}")
    return made[name]


def counts() -> list[Column]:
    return [F.count_if(F.col("valid") & F.col("value").isNotNull()).alias("n_samples"), F.count_if(~F.col("valid")).alias("excluded_faulted")]


#: Accuracy of the sketches that bound a median, and how far from the middle the bounds are taken, in its steps: sketches that were merged many times are less exact than they say.
RANKS, MARGIN = 100_000, 32


def medians(samples: DataFrame, by: tuple[str, ...] = ("device", "metric"), ranks: int = RANKS, margin: int = MARGIN) -> DataFrame:
    """(by, value): exact medians of the valid samples of a group, of which no task holds more than a small share.

    A sketch (mergeable, so every task reads its part of a hot series) gives two values about the middle. A second pass counts
    what is below them, and the distinct values between them, of which the one or two middle ones are picked. Where they turn
    out not to lie there, the group's percentile is taken as a whole.
    """
    v = samples.filter("valid AND value IS NOT NULL").select(*by, "value")
    off = min(margin / ranks, 0.5)
    bounds = v.groupBy(*by).agg(F.percentile_approx("value", [0.5 - off, 0.5 + off], F.lit(ranks)).alias("b"), F.count("*").alias("n"))
    at = v.join(bounds, list(by)).filter(F.col("value") <= F.element_at("b", 2))
    near = at.groupBy(*by, "n", F.when(F.col("value") >= F.element_at("b", 1), F.col("value")).alias("x")).agg(F.count("*").alias("k"))
    upto = near.withColumn("upto", F.sum("k").over(Window.partitionBy(*by).orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    middle = lambda rank: F.max(F.when(F.col("x").isNotNull() & (F.col("upto") - F.col("k") <= rank) & (rank < F.col("upto")), F.col("x")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    picked = upto.groupBy(*by).agg((0.5 * middle(low) + 0.5 * middle(high)).alias("value"))
    missed = picked.filter("value IS NULL").select(*by)
    return picked.filter("value IS NOT NULL").unionByName(v.join(missed, list(by), "left_semi").groupBy(*by).agg(F.percentile("value", 0.5).alias("value")))


def aggregate(samples: DataFrame, name: str, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """One row per group: value, n_samples, excluded_faulted, and for latest and earliest when it was observed."""
    s = samples.filter(F.col("value").isNotNull())
    if name == "median":
        counted = s.groupBy(*by).agg(*counts())
        return counted.join(medians(s, by), list(by), "left").select(*by, "value", "n_samples", "excluded_faulted")
    extra = {"latest": [F.max(_ok("at")).alias("observed_at")], "earliest": [F.min(_ok("at")).alias("observed_at")]}.get(name, [])
    return s.groupBy(*by).agg(statistic(name).alias("value"), *counts(), *extra)


def on_spine(result: DataFrame, spine: DataFrame, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """A result with a row for every group asked for: null values and zero counts where there are no samples."""
    out = spine.join(result, list(by), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_samples", "excluded_faulted")})


def raw(samples: DataFrame, limit: int = RAW_LIMIT, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """The newest ``limit`` valid samples of each group in time order, with the group's size and whether it was cut.

    The limit on the rank is applied in every task before the shuffle too (a window group limit), so one hot group moves few rows.
    """
    s = samples.filter("valid AND value IS NOT NULL")
    newest = Window.partitionBy(*by).orderBy(F.col("at").desc(), F.col("ord").desc())
    sizes = s.groupBy(*by).agg(F.count("*").alias("n_samples"))
    kept = s.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit)
    return kept.join(sizes, list(by)).select(*by, "at", "ord", "value", "n_samples", (F.col("n_samples") > limit).alias("truncated"), F.least("n_samples", F.lit(limit)).alias("kept"))


def _buckets(s: DataFrame, by: tuple[str, ...], cap: int) -> DataFrame:
    """Mean, min, max and count by start and width; per group the newest ``cap`` buckets."""
    made = s.groupBy(*by, "start_ms", "width_ms").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    newest = Window.partitionBy(*by).orderBy(F.col("start_ms").desc())
    return made.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= cap).drop("rn").withColumn("end_ms", F.col("start_ms") + F.col("width_ms"))


def series(samples: DataFrame, width: str = "auto", cap: int = MAX_BUCKETS, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """Epoch-aligned buckets of valid samples without filling: named widths, or per group the least of a ladder that needs no more than ``cap``."""
    s = samples.filter("valid AND value IS NOT NULL").withColumn("ms", epoch_ms(F.col("at")))
    if width != "auto":
        return _buckets(s.withColumn("width_ms", F.lit(WIDTHS[width])).withColumn("start_ms", bucket_start(F.col("ms"), F.col("width_ms"))), by, cap)
    spans = s.groupBy(*by).agg((F.max("ms") - F.min("ms")).alias("span"))
    s = s.join(spans.select(*by, auto_width(F.col("span"), cap).alias("width_ms")), list(by))
    return _buckets(s.withColumn("start_ms", bucket_start(F.col("ms"), F.col("width_ms"))), by, cap)


def auto_width(span_ms: Column, cap: int = MAX_BUCKETS) -> Column:
    ladder = [int(h * HOUR_MS) for h in LADDER_HOURS]
    chosen = F.when(span_ms <= 0, F.lit(HOUR_MS))
    for w in ladder[:-1]:
        chosen = chosen.when(span_ms <= w * cap, F.lit(w))
    return chosen.otherwise(F.lit(ladder[-1])).cast("long")


def weighted_merge(buckets: DataFrame, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """Whole-window statistics from buckets: the mean by counts, least of the least, greatest of the greatest."""
    return buckets.groupBy(*by).agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("n")
    )


def segments(buckets: DataFrame, by: tuple[str, ...] = ("device", "metric"), step_ms: Column | None = None) -> DataFrame:
    """Buckets with the number of the unbroken run they are in.

    A run ends where the next bucket starts after the end of one; where a bucket has no end, where the middles are more
    than one and a half steps apart: the given step, or else the usual distance (`spacing`).
    """
    w = Window.partitionBy(*by).orderBy("start_ms")
    has_end = F.col("end_ms") > F.col("start_ms")
    b = buckets.withColumn("mid_ms", midpoint(F.col("start_ms"), F.col("end_ms")))
    if step_ms is None:
        b, step = b.join(spacing(buckets, by, "mid_ms"), list(by), "left"), F.col("spacing_ms")
    else:
        step = step_ms
    apart = F.when(F.lag(has_end).over(w), F.col("start_ms") > F.lag("end_ms").over(w)).otherwise((step > 0) & (F.col("mid_ms") - F.lag("mid_ms").over(w) > 1.5 * step))
    gap = F.coalesce(apart.cast("int"), F.lit(0))
    return b.withColumn("gap", gap).withColumn("segment", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*buckets.columns, "segment")


def plottable(buckets: DataFrame, by: tuple[str, ...] = ("device", "metric"), least: int = 3) -> DataFrame:
    """Buckets fit for a chart: finite figures, a start, samples; the band holds the mean. Series of fewer than ``least`` buckets are left out."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("mean", "min", "max")]
    ok = finite[0] & finite[1] & finite[2] & F.col("start_ms").isNotNull() & F.coalesce(F.col("n") > 0, F.lit(True))
    end = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms"))
    b = buckets.filter(ok).select(*by, "start_ms", end.alias("end_ms"), midpoint(F.col("start_ms"), F.col("end_ms")).alias("mid_ms"), "mean", F.least("min", "max", "mean").alias("min"), F.greatest("min", "max", "mean").alias("max"), "n")
    return b.withColumn("buckets", F.count("*").over(Window.partitionBy(*by))).filter(F.col("buckets") >= least)


def all_metrics(samples: DataFrame, name: str = "mean") -> DataFrame:
    """Per device a map of metric to (value, n_samples, excluded_faulted), the greatest count, the faults, and the time of observation if all metrics share it.

    Only latest and earliest are observed at one time.
    """
    by = aggregate(samples, name, ("device", "metric"))
    seen = F.col("observed_at") if "observed_at" in by.columns else F.lit(None).cast("timestamp")
    by = by.withColumn("seen", seen)
    entry = F.struct("metric", F.struct("value", "n_samples", "excluded_faulted"))
    return by.groupBy("device").agg(
        F.map_from_entries(F.collect_list(entry)).alias("metrics"), F.max("n_samples").alias("n_most"), F.sum("excluded_faulted").alias("excluded_faulted"),
        F.when(F.count_distinct("seen") == 1, F.max("seen")).alias("observed_at"),
    )  # a handful of metrics to a device


def spacing(buckets: DataFrame, by: tuple[str, ...] = ("device", "metric"), at: str = "start_ms") -> DataFrame:
    """The usual distance between buckets: the upper of the two middles, never their average."""
    w = Window.partitionBy(*by).orderBy("at")
    place = midpoint(F.col("start_ms"), F.col("end_ms")) if at == "mid_ms" else F.col(at)
    steps = buckets.withColumn("at", place).withColumn("step", F.col("at") - F.lag("at").over(w)).filter("step IS NOT NULL")
    listed = steps.groupBy(*by).agg(F.sort_array(F.collect_list("step")).alias("steps"))  # at most as many as a series has buckets
    return listed.select(*by, F.element_at("steps", F.floor(F.size("steps") / 2).cast("int") + 1).alias("spacing_ms"))


def trend(buckets: DataFrame, by: tuple[str, ...] = ("device", "metric")) -> DataFrame:
    """Whether a series rises, falls or stays: its last bucket's mean against the first one's; a change of less than a tenth of the whole band is none."""
    s = buckets.groupBy(*by).agg(F.min_by("mean", "start_ms").alias("first"), F.max_by("mean", "start_ms").alias("last"), (F.max("max") - F.min("min")).alias("spread"))
    change = F.col("last") - F.col("first")
    moves = (F.col("spread") > 0) & (F.abs(change) >= 0.1 * F.col("spread"))
    return s.select(*by, F.when(moves & (change > 0), "rises").when(moves, "falls").otherwise("stays").alias("trend"))


def healthy_averages(samples: DataFrame, devices: list | None = None) -> DataFrame:
    """Per device and metric the mean over those rows (readings of a device at one time) on which no probe is faulted."""
    if devices is not None:
        samples = samples.filter(F.col("device").isin(*devices))
    w = Window.partitionBy("device", "at")
    healthy = samples.withColumn("healthy", F.min(F.col("valid").cast("int")).over(w) == 1).filter("healthy AND value IS NOT NULL")
    return healthy.groupBy("device", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def faulted_rows(samples: DataFrame) -> DataFrame:
    """The readings (device, at) on which any probe is faulted."""
    return samples.groupBy("device", "at").agg(F.max((~F.col("valid")).cast("int")).alias("any")).filter("any = 1").drop("any")


# Readings above which dissolved oxygen must be a share of saturation, and up to which a maximum temperature must be Celsius; the range of dissolved oxygen that operators are told.
SATURATION_FROM, CELSIUS_UP_TO, OXYGEN_RANGE = 20.0, 40.0, (5.0, 14.0)


def unit_hints(samples: DataFrame) -> DataFrame:
    """(device, metric, hint): what the values of a series say of their unit, where they contradict the one that is meant. Advice only, nothing is converted."""
    s = samples.filter("valid AND value IS NOT NULL").groupBy("device", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    oxygen = F.when(F.col("mean") > SATURATION_FROM, "looks like % saturation, not mg/L").when((F.col("mean") < OXYGEN_RANGE[0]) | (F.col("mean") > OXYGEN_RANGE[1]), "outside the operator range")
    warmth = F.when(F.col("high") <= CELSIUS_UP_TO, "looks like °C, not °F")
    hint = F.when(F.col("metric") == "dissolved_oxygen", oxygen).when(F.col("metric") == "temperature", warmth)
    return s.withColumn("hint", hint).filter("hint IS NOT NULL").select("device", "metric", "hint")
