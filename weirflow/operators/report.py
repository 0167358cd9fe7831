"""Reports of a fleet in one plan: statistics against baselines, flags, excursion windows, merged events with
their classification, and status. Sites are independent, so everything is partitioned by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import plain_number, sentence_case
from weirflow.operators.dimensions import ACCURACY_ABSOLUTE, ACCURACY_SHARE, METRICS
from weirflow.operators.intervals import within

# How long an excursion lasts at least, margins and limits of flags, severities and confidences.
MIN_EXCURSION = "interval 1 hour"
EXCEEDANCE_MARGIN = 0.15
CONFIDENCE_FLOOR, NOTIFY_FROM = 0.5, 0.6
BLOOM_CONFIDENCE, BLOOM_CONFIRMED = 0.45, 0.6
# What a pattern does, in words; patterns that open no windows, and those under which a parameter within its baseline is steady.
PATTERNS = {
    "diel": "followed a clear diel rhythm", "tidal": "tracked the tidal cycle", "event-driven": "was flat outside a discrete excursion window", "flat": "held steady",
    "irregular": "showed irregular, non-periodic variation", "unknown": "showed no clearly classified pattern",
}
RHYTHMS, STEADY = ("diel", "tidal"), ("flat", "unknown")
#: Length of the stretches in which excursions are looked for before they are joined, so that one long series is many tasks' work.
STRETCH_MS = 30 * 86_400_000


def outside() -> Column:
    return (F.col("value") < F.col("baseline_min")) | (F.col("value") > F.col("baseline_max"))


def with_pattern(series: DataFrame) -> DataFrame:
    """The series with a pattern, which is unknown where nothing else is said."""
    return series.withColumn("pattern", F.coalesce("pattern", F.lit("unknown")) if "pattern" in series.columns else F.lit("unknown"))


def excursions(series: DataFrame) -> DataFrame:
    """(site, metric, window_start, window_end): runs of consecutive samples outside the baseline that last an hour or more.

    ``series``: site, metric, at, ord, value, baseline_min, baseline_max, and a pattern if it is known: diel and tidal
    series have no windows. A gap in time does not end a run; one open at the end ends there.

    Runs are found within stretches of fixed length, and a run that touches the end of one is joined with the run that
    touches the start of the next, so no task sorts a whole series.
    """
    s = with_pattern(series).filter(F.col("value").isNotNull() & F.col("baseline_min").isNotNull() & ~F.col("pattern").isin(*RHYTHMS))
    s = s.select("site", "metric", "at", "ord", outside().alias("out"), F.floor(F.unix_millis("at") / STRETCH_MS).alias("stretch"))
    order = Window.partitionBy("site", "metric", "stretch").orderBy("at", "ord")
    s = s.withColumns({"before": F.lag("out").over(order), "after": F.lead("out").over(order)})
    s = s.withColumn("run", F.sum((F.col("out") & ~F.coalesce("before", F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Samples within the baseline make one row of a stretch, so that it is known to be there.
    runs = s.groupBy("site", "metric", "stretch", "out", F.when(F.col("out"), F.col("run")).alias("run")).agg(
        F.min("at").alias("window_start"), F.max("at").alias("window_end"), F.bool_or(F.col("before").isNull()).alias("from_start"), F.bool_or(F.col("after").isNull()).alias("to_end")
    )
    stretches = Window.partitionBy("site", "metric").orderBy("stretch")
    runs = runs.withColumn("place", F.dense_rank().over(stretches)).filter("out")
    starts = Window.partitionBy("site", "metric").orderBy("window_start", "stretch")
    goes_on = F.col("from_start") & F.lag("to_end").over(starts) & (F.col("place") == F.lag("place").over(starts) + 1)
    runs = runs.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    runs = runs.withColumn("whole", F.sum("fresh").over(starts.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("site", "metric", "whole").agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")).drop("whole")
    return whole.filter(F.expr(f"window_end - window_start >= {MIN_EXCURSION}"))


def merged(windows: DataFrame) -> DataFrame:
    """(site, event_start, event_end): overlapping or touching windows of all metrics of a site as one."""
    order = Window.partitionBy("site").orderBy("window_start", "window_end")
    before = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = windows.withColumn("fresh", F.coalesce((F.col("window_start") > before).cast("int"), F.lit(0)))
    w = w.withColumn("event", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return w.groupBy("site", "event").agg(F.min("window_start").alias("event_start"), F.max("window_end").alias("event_end")).drop("event")


def movements(series: DataFrame, events: DataFrame, digits: int | None = None) -> DataFrame:
    """Per event and metric the mean, least and greatest value inside it, and where the mean left the baseline: up or down.

    Samples and events meet by site and day (`intervals.within`), so a site's work is linear in its samples and spread over
    its days. The last bits of a mean depend on the order of its sum, which parts of a table don't have. With ``digits`` no
    figure rounded to so many, and no direction, depends on it: means so near to a tie, or to an edge of the baseline, that another
    order might take them across are summed once more, in the order of ``ord``.
    """
    inside = within(series.filter("value IS NOT NULL AND baseline_min IS NOT NULL"), events, ["site"], "event_start", "event_end")
    key = ["site", "event_start", "event_end", "metric", "baseline_min", "baseline_max"]
    m = inside.groupBy(*key).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"), F.sum(F.abs("value")).alias("size"))
    if digits is not None:
        m = m.join(_means_in_order(inside, m, key, digits).hint("merge"), key, "left").withColumn("mean", F.coalesce("ordered", "mean"))
    m = m.select(*key, "mean", "min", "max")
    return m.withColumn("moved", F.when(F.col("mean") > F.col("baseline_max"), "up").when(F.col("mean") < F.col("baseline_min"), "down"))


def _means_in_order(inside: DataFrame, means: DataFrame, key: list[str], digits: int) -> DataFrame:
    """(key, ordered): means summed by ``ord``, where the order decides. Sums of n doubles are at most n units of their last place (of the sum of absolute values) from each other."""
    off = F.col("size") * 2.0**-51
    scaled, near = F.abs(F.col("mean")) * 10.0**digits, off * 10.0**digits + F.abs(F.col("mean")) * 10.0**digits * 2.0**-51
    tie = F.abs(scaled - F.floor(scaled) - 0.5) <= near
    edge = (F.abs(F.col("mean") - F.col("baseline_min")) <= off) | (F.abs(F.col("mean") - F.col("baseline_max")) <= off)
    close = means.filter(tie | edge).select(*key)
    order = Window.partitionBy(*key).orderBy("ord")
    so_far = inside.join(close.hint("merge"), key, "left_semi").select(*key, "ord", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(order).alias("n"))
    return so_far.groupBy(*key).agg((F.max_by("total", "n") / F.max("n")).alias("ordered"))


def classify(moves: Column) -> Column:
    """(type, confidence) from a map of metric to up or down; the first rule that holds decides."""
    m = lambda k: F.element_at(moves, k)
    up, down, still = (lambda k: F.coalesce(m(k) == "up", F.lit(False))), (lambda k: F.coalesce(m(k) == "down", F.lit(False))), (lambda k: m(k).isNull())
    do, orp, ph, cond, temp, turb = "dissolved_oxygen", "orp", "ph", "conductivity", "temperature", "turbidity"
    rules = [
        (down(do) & down(orp) & up(turb) & up(cond), "Sewage", 0.70),
        (down(do) & down(orp) & up(turb), "Sewage", 0.50),
        (down(do) & down(orp) & ~up(turb) & ~up(cond), "Hypoxia", 0.60),
        (up(temp) & down(do) & still(orp) & still(ph) & still(cond) & still(turb), "Thermal", 0.60),
        (up(temp) & still(do) & still(orp) & still(ph) & still(cond) & still(turb), "Thermal", 0.40),
        (down(ph) & up(cond), "Acidic input", 0.55),
        (up(cond) & still(do) & still(orp) & still(ph) & still(turb), "Saltwater intrusion", 0.45),
        (up(turb) & ~still(cond), "Stormwater", 0.50),
        (up(turb), "Stormwater", 0.40),
        (up(cond) | ~still(ph) | ~still(orp), "Industrial", 0.30),
    ]
    pair = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(rules[0][0], pair(*rules[0][1:]))
    for condition, kind, confidence in rules[1:]:
        out = out.when(condition, pair(kind, confidence))
    return out.otherwise(pair("Inconclusive", 0.20))


def severity(start: Column, end: Column) -> Column:
    hours = (F.unix_millis(end) - F.unix_millis(start)) / 3_600_000
    return F.when(hours > 12, "High").when(hours > 3, "Moderate").otherwise("Low")


def events(series: DataFrame) -> DataFrame:
    """All events of all sites, blooms after the others: site, event_start, event_end, type, confidence, severity, follow_up, n_moved."""
    moved = movements(series, merged(excursions(series))).filter("moved IS NOT NULL")
    per = moved.groupBy("site", "event_start", "event_end").agg(F.map_from_entries(F.collect_list(F.struct("metric", "moved"))).alias("moves"), F.count("*").alias("n_moved"))  # a handful of metrics to a site
    per = per.withColumn("c", classify(F.col("moves")))
    confidence = F.col("c.confidence")
    found = per.select(
        "site", "event_start", "event_end", F.when(confidence < CONFIDENCE_FLOOR, "Inconclusive").otherwise(F.col("c.type")).alias("type"), confidence.alias("confidence"),
        severity(F.col("event_start"), F.col("event_end")).alias("severity"), F.when(confidence < NOTIFY_FROM, "Grab sample").otherwise("Notify stakeholder").alias("follow_up"), "n_moved", F.lit(0).alias("part"),
    )
    if "pattern" not in series.columns:
        return found
    extremes = series.filter("value IS NOT NULL AND baseline_min IS NOT NULL").groupBy("site", "metric", "pattern", "baseline_max").agg(F.max("value").alias("max"))
    bloom = blooms(series, extremes).withColumns({"n_moved": F.lit(1).cast("long"), "part": F.lit(1)})
    return found.unionByName(bloom.select(*found.columns))


def daily_swings(series: DataFrame) -> DataFrame:
    """Per site and metric the first day whose values go beyond both edges of the baseline, with its extremes and span."""
    days = series.filter("value IS NOT NULL AND baseline_min IS NOT NULL").groupBy("site", "metric", F.to_date("at").alias("day"), "baseline_min", "baseline_max").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.min("at").alias("day_start"), F.max("at").alias("day_end")
    )
    both = days.filter("max > baseline_max AND min < baseline_min")
    first = both.groupBy("site", "metric").agg(F.min_by(F.struct("day", "min", "max", "day_start", "day_end"), "day").alias("s"))
    return first.select("site", "metric", "s.*")


def blooms(series: DataFrame, parameters: DataFrame) -> DataFrame:
    """Algal blooms: dissolved oxygen with a daily pattern that swings beyond both edges within a day; a like pattern of pH above its baseline confirms it.

    ``parameters``: site, metric, pattern, max, baseline_max.
    """
    diel = parameters.filter("pattern = 'diel'")
    swings = daily_swings(series).filter("metric = 'dissolved_oxygen'").join(diel.filter("metric = 'dissolved_oxygen'").select("site"), "site", "left_semi")
    ph = diel.filter("metric = 'ph' AND max > baseline_max").select("site", F.lit(True).alias("confirmed"))
    out = swings.join(ph, "site", "left")
    confidence = F.when(F.col("confirmed"), BLOOM_CONFIRMED).otherwise(BLOOM_CONFIDENCE)
    return out.select("site", F.col("day_start").alias("event_start"), F.col("day_end").alias("event_end"), F.lit("Algal bloom").alias("type"), confidence.alias("confidence"), F.lit("Moderate").alias("severity"), F.lit("Grab sample").alias("follow_up"))


def accuracy(metric: Column, reading: Column) -> Column:
    """What the probe can tell apart near a reading; temperature readings in Celsius."""
    out = F.when(metric == "temperature", 0.15 + 0.002 * F.abs(reading))
    for k, v in ACCURACY_ABSOLUTE.items():
        out = out.when(metric == k, F.lit(v))
    for k, v in ACCURACY_SHARE.items():
        out = out.when(metric == k, v * F.abs(reading))
    return out.otherwise(F.lit(0.0))


def flag(metric: Column, low: Column, high: Column, base_min: Column, base_max: Column) -> Column:
    """N/A without a baseline, else Exceedance, Elevated, Low or Normal, with the probe's accuracy as noise floor."""
    margin = (base_max - base_min) * EXCEEDANCE_MARGIN
    at_high, at_low = accuracy(metric, high), accuracy(metric, low)
    beyond = (high > base_max + F.greatest(margin, at_high)) | (low < base_min - F.greatest(margin, at_low))
    return F.when(base_min.isNull() | base_max.isNull(), "N/A").when(beyond, "Exceedance").when(high > base_max + at_high, "Elevated").when(low < base_min - at_low, "Low").otherwise("Normal")


def parameters(series: DataFrame) -> DataFrame:
    """Per site and metric: statistics from all samples in one pass, the flag, and when the baseline was first left."""
    s = with_pattern(series).filter("value IS NOT NULL")
    p = s.groupBy("site", "metric", "baseline_min", "baseline_max").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"),
        F.min(F.when(outside(), F.col("at"))).alias("first_excursion"), F.count("*").alias("n"), F.max("pattern").alias("pattern"),
    )
    return p.withColumn("flag", flag(*[F.col(c) for c in ("metric", "min", "max", "baseline_min", "baseline_max")]))


def from_buckets(buckets: DataFrame, medians: DataFrame) -> DataFrame:
    """(site, metric, min, max, mean, median, n) of a report from bucketed series and the medians of raw samples; where there is no median the mean stands for it."""
    merged_buckets = buckets.groupBy("site", "metric").agg(
        F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    ).filter("n > 0")
    joined = merged_buckets.join(medians.select("site", "metric", F.col("value").alias("known")), ["site", "metric"], "left")
    return joined.select("site", "metric", "min", "max", "mean", F.coalesce("known", "mean").alias("median"), "n")


def held_steady(flag: Column, pattern: Column) -> Column:
    return (flag == "Normal") & pattern.isin(*STEADY)


def status(params: DataFrame, found: DataFrame) -> DataFrame:
    """(site, status): Action Required, Watch or Normal, from the gravest flag or event."""
    by_flag = F.when(F.col("flag") == "Exceedance", 2).when(F.col("flag").isin("Elevated", "Low"), 1).otherwise(0)
    by_event = F.when(F.col("severity") == "High", 2).when(F.col("severity").isin("Low", "Moderate"), 1).otherwise(0)
    both = params.select("site", by_flag.alias("grade")).unionByName(found.select("site", by_event.alias("grade")))
    worst = both.groupBy("site").agg(F.max("grade").alias("grade"))
    return worst.select("site", F.when(F.col("grade") == 2, "Action Required").when(F.col("grade") == 1, "Watch").otherwise("Normal").alias("status"))


def magnitude(extreme: Column, edge: Column, width: Column) -> Column:
    over = F.abs(extreme - edge) / width
    return F.when(width <= 0, "").when(over < 0.05, "marginally").when(over < 0.2, "slightly").when(over < 0.5, "notably").otherwise("sharply")


def analysis_lines(params: DataFrame) -> DataFrame:
    """(site, metric, line): a sentence for each parameter that did not hold steady. Its wording is fixed."""
    units = F.create_map(*[F.lit(x) for key, _, _, unit, _ in METRICS for x in (key, unit or "")])
    phrases = F.create_map(*[F.lit(x) for kv in PATTERNS.items() for x in kv])
    unit, phrase = F.element_at(units, F.col("metric")), sentence_case(F.element_at(phrases, F.col("pattern")))
    above = F.col("flag").isin("Elevated", "Exceedance") & (F.col("max") > F.col("baseline_max"))
    extreme, edge = F.when(above, F.col("max")).otherwise(F.col("min")), F.when(above, F.col("baseline_max")).otherwise(F.col("baseline_min"))
    word, side = magnitude(extreme, edge, F.col("baseline_max") - F.col("baseline_min")), F.when(above, "above").otherwise("below")
    article = F.when(F.lower("flag").rlike("^[aeiou]"), "an").otherwise("a")
    span = F.concat(plain_number(F.col("baseline_min")), F.lit("-"), plain_number(F.col("baseline_max")), F.lit(" "), unit)
    none = F.concat(phrase, F.lit(". No fixed baseline exists for this parameter (climate/season-dependent per the source-of-truth doc) -- reported for reference only, not flagged against a range."))
    normal = F.concat(phrase, F.lit(", remaining within the "), span, F.lit(" site baseline."))
    left = F.concat(
        phrase, F.lit("; moved "), word, F.lit(" "), side, F.lit(" baseline, recording "), article, F.lit(" "), F.lower("flag"), F.lit(" reading of "), F.format_string("%.2f", extreme), F.lit(" "), unit,
        F.lit(" against the "), span, F.lit(" baseline."), F.when(F.col("first_excursion").isNull(), "").otherwise(F.concat(F.lit(" First left baseline at "), F.date_format("first_excursion", "yyyy-MM-dd HH:mm"), F.lit("."))),
    )
    line = F.when(F.col("flag") == "N/A", none).when(F.col("flag") == "Normal", normal).otherwise(left)
    return params.filter(~held_steady(F.col("flag"), F.col("pattern"))).select("site", "metric", line.alias("line"))


def summaries(params: DataFrame, found: DataFrame, period: str) -> DataFrame:
    """(site, status, bullets): the four lines at the head of a report over ``period`` ("D to D"). A parameter without a baseline counts as outside of it. Their wording is fixed."""
    names = F.create_map(*[F.lit(x) for key, _, label, *_ in METRICS for x in (key, label)])
    order = F.array(*[F.lit(m) for m, *_ in METRICS])
    p = params.groupBy("site").agg(F.array_sort(F.collect_list(F.when(F.col("flag") != "Normal", F.struct(F.array_position(order, F.col("metric")).alias("at"), F.element_at(names, F.col("metric")).alias("name"))))).alias("left"))
    e = found.groupBy("site").agg(F.count("*").alias("n"))
    j = status(params, found).join(p, "site").join(e, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    quiet = (F.col("n") == 0) & (F.col("status") == "Normal")
    flagged = F.when(F.size("left") > 0, F.array_join(F.transform("left", lambda x: x["name"]), ", ")).otherwise("no parameters")
    happened = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" candidate event(s) were identified"))).otherwise("no discrete pollution events were identified, though readings moved outside baseline")
    calm = F.array(
        F.concat(F.lit("Overall status: "), "status", F.lit(" — no action required at this time.")), F.lit(f"All parameters held within the site baseline for the {period} reporting period."),
        F.lit("No pollution event signatures were identified; diel and tidal rhythms tracked the site baseline throughout."), F.lit("Recommendation: continue routine monitoring."),
    )
    moved = F.array(
        F.concat(F.lit("Overall status: "), "status", F.lit(".")), F.concat(sentence_case(flagged), F.lit(f" moved outside the site baseline for the {period} reporting period.")),
        F.concat(sentence_case(happened), F.lit(".")), F.lit("Recommendation: see Recommendations below for the operational, investigative, and stakeholder follow-up."),
    )
    return j.select("site", "status", F.when(quiet, calm).otherwise(moved).alias("bullets"))


def section_numbers(sections: list[tuple[str, bool]], first: int = 1) -> dict[str, int]:
    """The numbers of the sections of a report that are there."""
    there = [name for name, present in sections if present]
    return {name: first + i for i, name in enumerate(there)}


def recommendations(params: DataFrame, found: DataFrame) -> DataFrame:
    """(site, operational, investigative, stakeholder). Their wording is fixed."""
    p = params.groupBy("site").agg(F.count_if(F.col("flag") != "Normal").alias("flagged"))
    e = found.groupBy("site").agg(F.count("*").alias("n_events"), F.count_if(F.col("severity") == "High").alias("grave"))
    j = p.join(e, "site", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "grave")})
    act = (F.col("flagged") > 0) | (F.col("n_events") > 0)
    return j.select(
        "site",
        F.when(act, "Recalibrate and inspect sensors on flagged parameters at next service window.").otherwise("No action needed; maintain routine calibration schedule.").alias("operational"),
        F.when(~act, "None required this period.").when(F.col("n_events") > 0, "Collect grab samples to confirm flagged readings and corroborate event classification.").otherwise("Collect grab samples to confirm flagged readings.").alias("investigative"),
        F.when(~act, "Routine report distribution to client only.").when(F.col("grave") > 0, "Notify client and relevant authority given event severity.").otherwise("Notify client.").alias("stakeholder"),
    )
