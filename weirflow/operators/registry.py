"""Devices: registry rows, tiered fuzzy names, decoding of their readings, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import fahrenheit, initials, lenient_double, normalised, usable_position, valid_flag
from weirflow.operators.dimensions import METRICS


def first_by_label(devices: DataFrame, label: str = "label", order: str = "ord") -> DataFrame:
    """The first row of each label in source order; rows without a label go."""
    w = Window.partitionBy(label).orderBy(order)
    return devices.filter(F.col(label).isNotNull()).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def match_tier(name: Column, label: Column, query: str) -> Column:
    """1 the label, 2 the name, 3 the initials, 4 a part of the name (three characters or more), 5 the start of the initials (two or more); null for no match. The order is fixed."""
    q = query.strip().lower()
    n, l, i = normalised(F.coalesce(name, F.lit(""))), normalised(F.coalesce(label, F.lit(""))), initials(F.coalesce(name, F.lit("")))
    out = F.when(l == q, 1).when(n == q, 2).when(i == q, 3)
    if len(q) >= 3:
        out = out.when(n.contains(q), 4)
    if len(q) >= 2:
        out = out.when(i.startswith(q), 5)
    return out


def matches(devices: DataFrame, query: str, name: str = "name", label: str = "label") -> DataFrame:
    """All devices of the best tier that any device reaches; the least tier is one aggregate, joined back as a single row."""
    tiers = devices.withColumn("tier", match_tier(F.col(name), F.col(label), query)).filter("tier IS NOT NULL")
    return tiers.join(F.broadcast(tiers.agg(F.min("tier").alias("tier"))), "tier")


def matches_of(asked: DataFrame, devices: DataFrame, name: str = "name", label: str = "label") -> DataFrame:
    """For every distinct name of a table ``asked`` (asked) the devices of the best tier that any device reaches: asked (trimmed, in lower case), tier, and the columns of ``devices``.

    The same rows as `matches` for each name, in one plan. A tier is an equality of keys: labels, names and initials as they
    are, the starts of initials, and for parts of names groups of three characters, of which a question looks up its
    rarest; what meets there is checked. So questions are never compared with all devices, but for those that match them.

    Texts that many devices share are looked up once, and parts only for questions that are no whole text of a device. What
    is found are texts, and devices join those at the end. All joins are of sorted parts: what explodes is estimated by the
    size of its files, far too small, and would be sent whole through the driver.
    """
    q = asked.select(F.lower(F.regexp_replace("asked", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("asked")).filter("asked IS NOT NULL").distinct()
    text = lambda c: normalised(F.coalesce(F.col(c), F.lit("")))
    first = initials(F.coalesce(F.col(name), F.lit("")))
    grams = lambda c: F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))
    starts = lambda c: F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(2), F.length(c)), lambda i: F.substring(c, F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    # A text is a label (1), a name (2) or initials (3); these are also the tiers of questions that are such a text.
    texts_of = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("text")) for kind, c in ((1, text(label)), (2, text(name)), (3, first))]))
    texts = devices.select(texts_of.alias("t")).select("t.*").distinct()
    whole = texts.groupBy(F.col("text").alias("asked")).agg(F.min("kind").alias("kind"))
    placed = q.join(whole.hint("merge"), "asked", "left")
    exact = placed.filter("kind IS NOT NULL").select("asked", F.col("kind").alias("tier"), "kind", F.col("asked").alias("text"))
    rest = placed.filter("kind IS NULL").select("asked")
    parts = texts.filter("kind = 2").select("text", F.explode(grams(F.col("text"))).alias("key"))
    counts = parts.groupBy("key").agg(F.count("*").alias("n"))
    # A group of three characters that no name has is the rarest, and leaves nothing to be looked up.
    sought = rest.select("asked", F.explode(grams(F.col("asked"))).alias("key")).join(counts.hint("merge"), "key", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("g"))
    inside = sought.filter("g.n > 0").select("asked", F.col("g.key").alias("key")).join(parts.hint("merge"), "key").filter(F.col("text").contains(F.col("asked"))).select("asked", F.lit(4).alias("tier"), F.lit(2).alias("kind"), "text")
    begun = texts.filter("kind = 3").select("text", F.explode(starts(F.col("text"))).alias("asked"))
    others = rest.join(inside.select("asked").distinct().hint("merge"), "asked", "left_anti").join(begun.hint("merge"), "asked").select("asked", F.lit(5).alias("tier"), F.lit(3).alias("kind"), "text")
    found = exact.unionByName(inside).unionByName(others)
    d = devices.select(F.struct(*[F.col(c) for c in devices.columns]).alias("_device"), texts_of.alias("t")).select("_device", "t.*")
    return found.join(d.hint("merge"), ["kind", "text"]).select("asked", "tier", "_device.*")


def resolve_one(devices: DataFrame, query: str | None, default: str | None = None) -> str:
    """The label of exactly one device. Raises LookupError for none and for several, listing up to ten."""
    asked = (query or "").strip() or (default or "").strip()
    found = (matches(devices, asked) if asked else devices).select("label").distinct().orderBy("label").limit(11).collect()
    labels = [r.label for r in found]
    if len(labels) != 1:
        raise LookupError(f"{'no device' if not labels else 'several devices'} for {asked!r}: {', '.join(labels[:10])}")
    return labels[0]


def decode(documents: DataFrame, body: str = "body", unit: str = "fahrenheit") -> DataFrame:
    """Tall readings (device, at, metric, value, valid, lat, lon) from JSON bodies, enveloped or bare.

    Paths are read once per row by generated code; six metrics come out of one pass by an explode of a
    literal array, without a join. Values that are no finite number are null.
    """
    at = lambda path: F.coalesce(F.get_json_object(body, f"$.data.{path}"), F.get_json_object(body, f"$.{path}"))
    readings = F.array(*[F.struct(F.lit(key).alias("metric"), at(f"water_data.{code}").alias("raw"), at(f"water_data.{error}").alias("flag")) for key, code, _, _, error in METRICS])
    place = usable_position(*[(lenient_double(at(a)), lenient_double(at(b))) for a, b in (("lat", "lon"), ("best_lat", "best_lon"), ("water_data.lat", "water_data.lon"))])
    d = documents.select(at("device").alias("device"), F.timestamp_seconds(lenient_double(at("timestamp"))).alias("at"), place.alias("place"), F.explode(readings).alias("r"))
    value = fahrenheit(lenient_double(F.col("r.raw")), F.col("r.metric"), F.lit(unit))
    return d.select("device", "at", F.col("r.metric").alias("metric"), value.alias("value"), valid_flag(lenient_double(F.col("r.flag"))).alias("valid"), F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"))


def latest(samples: DataFrame) -> DataFrame:
    """Each device's newest reading, as one row."""
    return samples.groupBy("device").agg(F.max_by(F.struct("metric", "at", "value", "valid"), F.struct("at", "ord")).alias("s")).select("device", "s.*")


def latest_with_fix(readings: DataFrame) -> DataFrame:
    """Each device's newest reading that has a position: a latitude that is neither null nor zero."""
    fixed = readings.filter("lat IS NOT NULL AND lat <> 0")
    return fixed.groupBy("device").agg(F.max_by(F.struct("metric", "at", "value", "valid", "lat", "lon"), F.struct("at", "ord")).alias("s")).select("device", "s.*")


def registered(rows: DataFrame, organization: str | None = None, data: str = "data") -> DataFrame:
    """Registry rows (id, and a struct of data) as devices, of one organisation where one is named: the filter reaches the scan."""
    d = rows.select("id", f"{data}.*")
    return d.filter(F.col("organization") == organization) if organization is not None else d


def matching_any(devices: DataFrame, parts: list[str], columns: tuple[str, ...] = ("name", "label")) -> DataFrame:
    """Devices of which a column has one of the parts, whatever their case; all of them where no part is given."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return devices.filter(F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: hay.contains(p))) if parts else devices


def by_display_name(devices: DataFrame) -> DataFrame:
    """In the order of a reader: by name, by label where there is none, then by label."""
    return devices.orderBy(F.collate(F.coalesce("name", "label"), "UNICODE"), "label")


def with_last_reading(devices: DataFrame, samples: DataFrame) -> DataFrame:
    """Devices with the time of their newest reading, null where there is none."""
    return devices.join(samples.groupBy("device").agg(F.max("at").alias("last_at")), "device", "left")


def water_type(environment: Column, fallback: str) -> Column:
    e = F.lower(environment)
    return F.when(e.contains("salt"), "Marine").when(e.contains("fresh"), "Freshwater").otherwise(F.lit(fallback))
