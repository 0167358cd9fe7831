"""Column functions of the sensor and document domains; all are built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark boilerplate, and the limits of a good chunk.
BOILERPLATE = ("adobe acrobat", "acrobat reader", "click here to download")
MIN_CHUNK, MIN_ALPHA = 100, 0.5


def lenient_double(text: Column) -> Column:
    """A finite number from a numeric string; null for blanks, words, NaN and infinities."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def valid_flag(flag: Column) -> Column:
    """A missing error flag, and one not above zero, mean a healthy reading."""
    return F.coalesce(flag <= 0, F.lit(True))


def fahrenheit(value: Column, metric: Column, unit: Column) -> Column:
    """Temperatures that their source gives in Celsius, in Fahrenheit; all else unchanged."""
    return F.when((metric == "temperature") & (unit == "celsius"), value * 9 / 5 + 32).otherwise(value)


def usable_position(*pairs: tuple[Column, Column]) -> Column:
    """The first pair of coordinates whose latitude is neither null nor zero."""
    return F.coalesce(*[F.when(lat.isNotNull() & (lat != 0), F.struct(lat.alias("lat"), lon.alias("lon"))) for lat, lon in pairs])


def empty_averages(values: Column) -> Column:
    """Whether all values of an array are exactly zero: a source's way to say that there were none."""
    return F.forall(values, lambda v: v.eqNullSafe(F.lit(0.0)))


def in_range(at: Column, start: Column, end: Column, end_inclusive: Column | bool) -> Column:
    inclusive = end_inclusive if isinstance(end_inclusive, Column) else F.lit(end_inclusive)
    return (at >= start) & ((at < end) | (inclusive & (at == end)))


def epoch_ms(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def bucket_start(ms: Column, width: Column) -> Column:
    """Floor to a multiple of the width counted from the epoch, also before it."""
    return (F.floor(ms / width) * width).cast("long")


def strict_date(text: Column) -> Column:
    """A date written exactly as yyyy-MM-dd that exists, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(text))


def initials(name: Column) -> Column:
    """First letters of the words that begin with a letter, in lower case."""
    words = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Za-z]"))
    return F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def alpha_ratio(text: Column) -> Column:
    """Share of ASCII letters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, "[^a-zA-Z]", "")) / n)


def good_chunk(text: Column, check_alpha: bool = True) -> Column:
    low = F.lower(text)
    ok = F.length(text) >= MIN_CHUNK
    if check_alpha:
        ok = ok & (alpha_ratio(text) >= MIN_ALPHA)
    for phrase in BOILERPLATE:
        ok = ok & ~low.contains(phrase)
    return ok


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("long")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def chunk_id(filename: Column, index: Column) -> Column:
    return F.concat(safe_id(filename), F.lit("__"), F.format_string("%04d", index))


def coordinates(lat: Column, lon: Column) -> Column:
    """Four decimals with hemispheres."""
    part = lambda v, a, b: F.concat(F.format_string("%.4f", F.abs(v)), F.lit("° "), F.when(v >= 0, a).otherwise(b))
    return F.concat(part(lat, "N", "S"), F.lit(", "), part(lon, "E", "W"))


def magnitude_decimals(value: Column) -> Column:
    """Whole numbers from a hundred, one decimal from ten, else two."""
    size = F.abs(value)
    return F.when(size >= 100, F.format_string("%.0f", value)).when(size >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def canonical_json(arguments: Column) -> Column:
    """JSON of a map of strings with its names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(arguments))))


def bearer(header: Column) -> Column:
    token = F.regexp_extract(F.trim(header), r"(?i)^bearer\s+(\S+)$", 1)
    return F.when(token != "", token)


def age_label(ms: Column) -> Column:
    """An age in words: rounded minutes below an hour, hours below two days, then days."""
    ago = lambda unit, word: F.concat(F.floor(ms / unit + 0.5).cast("string"), F.lit(f" {word} ago"))
    minute, hour, day = 60_000, 3_600_000, 86_400_000
    return (
        F.when(ms.isNull() | (ms < minute), "just now").when(F.floor(ms / minute + 0.5) < 60, ago(minute, "min"))
        .when(F.floor(ms / hour + 0.5) < 48, ago(hour, "h")).otherwise(ago(day, "days"))
    )


def date_slice(iso: Column) -> Column:
    """The date of an ISO instant as it is written, without a time zone."""
    return F.when(F.length(iso) >= 10, F.substring(iso, 1, 10))


def iso_instant(at: Column) -> Column:
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def freshness(last: Column, now: Column) -> Column:
    """What a device's last report (an ISO text) says: none, unreadable, reporting (within a day) or silent since a date."""
    at = last.try_cast("timestamp")
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at)
    since = F.concat(F.date_format(date_slice(last).try_cast("date"), "MMM"), F.lit(" "), F.dayofmonth(date_slice(last).try_cast("date")).cast("string"))
    return (
        F.when(last.isNull() | (last == ""), "No readings on record").when(at.isNull(), "Last reading time unavailable")
        .when(age < 86_400_000, F.concat(F.lit("Reporting · "), age_label(age))).otherwise(F.coalesce(F.concat(F.lit("Silent since "), since), F.lit("Silent for over a day")))
    )


def water_kind(environment: Column) -> Column:
    """saltwater if the text says salt, freshwater for any other, null for none."""
    return F.when(environment.isNotNull() & (environment != ""), F.when(F.lower(environment).contains("salt"), "saltwater").otherwise("freshwater"))


def mismatch(environment: Column, deployment: Column) -> Column:
    """The note that a device's water is not the deployment's; null where they agree or either is unknown."""
    return F.when(water_kind(environment) != water_kind(deployment), F.concat(sentence_case(environment), F.lit(" pod · thresholds are "), deployment))


def plain_number(value: Column) -> Column:
    """A double as text, without a fraction where it has none."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def midpoint(start_ms: Column, end_ms: Column) -> Column:
    """The middle of a bucket, its start where the end is unknown or not after it."""
    return F.when(end_ms > start_ms, (start_ms + end_ms) / 2).otherwise(start_ms.cast("double"))


def truncated(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def metric_label(metric: Column) -> Column:
    """A metric's name for people: underscores are blanks, three names are written in their own way."""
    m = F.when(metric == "all", "all metrics").when(metric == "ph", "pH").when(metric == "orp", "ORP").otherwise(F.replace(metric, F.lit("_"), F.lit(" ")))
    return F.when(metric != "", m)


# Words by which a question asks for a chart, and the sentence a refusal starts with.
CHART_WORDS = (
    "chart", "charts", "charted", "charting", "graph", "graphs", "graphed", "graphing", "plot", "plots", "plotted", "plotting", "trend", "trends", "trending", "sparkline", "sparklines",
    "visuali[sz]e", "visuali[sz]ed", "visuali[sz]es", "visuali[sz]ing", "visuali[sz]ation", "visuali[sz]ations", "over time", "time series", "timeseries",
)
REFUSAL = "I can only answer questions grounded in this sensor's readings or the loaded water-quality documents, and I don't have enough information to answer that."


def asks_for_chart(question: Column) -> Column:
    return question.rlike(rf"(?i)\b({'|'.join(CHART_WORDS)})\b")


def refuses(answer: Column) -> Column:
    return F.startswith(F.trim(answer), F.lit(REFUSAL))


def safe_filename(name: Column) -> Column:
    """Whether a name is one of a report, without a path."""
    return name.rlike(r"^[a-zA-Z0-9_-]+\.pdf$")


def metric_display(label: Column, value: Column, unit: Column, valid: Column, error_flag: Column) -> Column:
    """A reading for people: a dash for none, its unit, and a mark where the probe reports a fault."""
    unit_text = F.when(unit.isNull(), "").otherwise(F.concat(F.lit(" "), unit))
    fault = F.when(valid, "").otherwise(F.concat(F.lit("  [!] "), error_flag, F.lit(" set")))
    return F.when(value.isNull(), F.concat(label, F.lit(": —"))).otherwise(F.concat(label, F.lit(": "), plain_number(value), unit_text, fault))


def tool_arguments(text: Column) -> Column:
    """The arguments of a call as a map of JSON texts: none for a blank text, null for what is no JSON object."""
    t = F.trim(F.coalesce(text, F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    return F.when(t == "", F.from_json(F.lit("{}"), "map<string,string>")).when(is_object, F.from_json(t, "map<string,string>"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of numbers in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def array_cosine_guard(vector: Column, dim: int) -> Column:
    """A usable embedding: of the right length and not all zero."""
    return vector.isNotNull() & (F.size(vector) == dim) & F.exists(vector, lambda x: x != 0)
