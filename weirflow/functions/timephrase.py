"""Natural-language time windows: a small grammar, resolved against an anchor instant in UTC."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
# The spans of the units, the phrases for the newest reading, and the look-back ladder of sources with fixed windows.
SPANS = {"hour": HOUR, "day": DAY, "week": 7 * DAY, "month": 30 * DAY, "year": 365 * DAY}
LATEST = ("now", "latest", "current", "most recent", "last reading")
LADDER = (HOUR, DAY, 7 * DAY, 30 * DAY, 365 * DAY)

#: No window is longer, and none ends after year 9999.
LONGEST = 2000 * SPANS["year"]
LAST_DAY = datetime(9999, 12, 30, tzinfo=timezone.utc)

_ROLLING = re.compile(r"(?:last|past|previous) (?:([0-9]+) )?(hour|day|week|month|year)s?")
_DATES = re.compile(r"(\S+) (?:to|through|-|until) (\S+)")
_ISO = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


class PhraseError(ValueError):
    """A phrase outside the grammar."""


@dataclass(frozen=True)
class ParsedRange:
    """``kind`` is latest, rolling, calendar or absolute; only the fields of that kind are set."""

    kind: str
    label: str
    span: timedelta | None = None
    unit: str | None = None
    offset: int = 0
    start: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class ResolvedRange:
    start: datetime
    end: datetime
    label: str
    end_inclusive: bool


def strict_date(text: str) -> datetime | None:
    """Midnight UTC of a date written exactly as yyyy-MM-dd that exists."""
    if not _ISO.fullmatch(text):
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def parse(phrase: str) -> ParsedRange:
    """The window a phrase names. Raises PhraseError for what the grammar does not know."""
    words = " ".join(phrase.split()).lower()
    if not words:
        raise PhraseError("a time range is required")
    if words in LATEST:
        return ParsedRange("latest", words)
    if words in ("today", "yesterday"):
        return ParsedRange("calendar", words, unit="day", offset=-(words == "yesterday"))
    if words == "this week":
        return ParsedRange("calendar", words, unit="week")
    if words in ("last week", "past week"):
        return ParsedRange("rolling", "last week", span=SPANS["week"])
    if (m := _ROLLING.fullmatch(words)) and len((m[1] or "1").lstrip("0")) in range(1, 9) and (n := int(m[1] or 1)) * SPANS[m[2]] <= LONGEST:
        return ParsedRange("rolling", f"last {n} {m[2]}{'s' * (n != 1)}", span=n * SPANS[m[2]])
    two = _DATES.fullmatch(words)
    first, last = (two[1], two[2]) if two else (words, words)
    a, b = strict_date(first), strict_date(last)
    if a is None or b is None or b < a or b > LAST_DAY:
        raise PhraseError(f"cannot read {phrase!r}: use latest, today, yesterday, this week, last N hours/days/weeks/months/years, a date, or one date to another")
    return ParsedRange("absolute", f"{first} to {last}" if two else first, start=a, end=b + DAY)


def start_of(unit: str, at: datetime) -> datetime:
    """Start of the UTC day, or of the Monday-based week, that ``at`` is in."""
    day = at.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    return day if unit == "day" else day - day.weekday() * DAY


def resolve(parsed: ParsedRange, anchor: datetime) -> ResolvedRange:
    """Relative windows end at the anchor and include it; calendar and absolute ones exclude their end."""
    if parsed.kind == "latest":
        return ResolvedRange(anchor, anchor, parsed.label, True)
    if parsed.kind == "rolling":
        return ResolvedRange(anchor - parsed.span, anchor, parsed.label, True)
    if parsed.kind == "absolute":
        return ResolvedRange(parsed.start, parsed.end, parsed.label, False)
    span = SPANS[parsed.unit]
    start = start_of(parsed.unit, anchor) + parsed.offset * span
    return ResolvedRange(start, start + span, parsed.label, False)


def look_back(parsed: ParsedRange, anchor: datetime, now: datetime) -> timedelta:
    """How far before ``now`` a scan must reach to cover the window."""
    return max(now - resolve(parsed, anchor).start, timedelta(0))


def rung(span: timedelta) -> timedelta:
    """The shortest step of the ladder that covers a span; the last one beyond it."""
    return next((r for r in LADDER if r >= span), LADDER[-1])


def wider(step: timedelta) -> timedelta | None:
    return next((r for r in LADDER if r > step), None)


# The same grammar over columns, for tables of questions.

PARSED = "struct<kind:string,label:string,span_seconds:bigint,unit:string,offset:int,start:timestamp,end:timestamp>"


def _words(phrase: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(phrase, r"(?U)[\s\x1c-\x1f]+", " ")))


def _let(x: Column, f) -> Column:
    """f(x), with x evaluated once and f kept out of generated code, which these many cases would make too large."""
    return F.element_at(F.transform(F.array(x), f), 1)


def parsed(phrase: Column) -> Column:
    """The windows that phrases name, as a struct with the fields of `ParsedRange`; null for what the grammar does not know, and for null."""

    def field(kind: str, label: Column | str, span=None, unit: str | None = None, offset: int = 0, start=None, end=None) -> Column:
        null = lambda x: F.lit(None) if x is None else x
        return F.struct(F.lit(kind), F.lit(label) if isinstance(label, str) else label, null(span).cast("bigint"), F.lit(unit).cast("string"), F.lit(offset), null(start).cast("timestamp"), null(end).cast("timestamp")).cast(PARSED)

    def rolling(words: Column) -> Column:
        """Null for other phrases, and for lengths below one or beyond the longest."""
        unit, written = F.regexp_extract(words, f"^{_ROLLING.pattern}$", 2), F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(words, f"^{_ROLLING.pattern}$", 1), F.lit("")), F.lit("1")), "^0+", "")
        seconds = F.element_at(F.create_map(*[F.lit(x) for k, v in SPANS.items() for x in (k, int(v.total_seconds()))]), unit)
        made = lambda n: F.when((n >= 1) & (n * seconds <= int(LONGEST.total_seconds())), field("rolling", F.concat(F.lit("last "), n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s")), span=n * seconds))
        return F.when(unit != "", _let(F.when(F.length(written) < 9, written.try_cast("bigint")), made))

    def absolute(words: Column) -> Column:
        two = words.rlike(f"^{_DATES.pattern}$")
        part = lambda i: F.when(two, F.regexp_extract(words, f"^{_DATES.pattern}$", i)).otherwise(words)
        day = lambda text: F.when(text.rlike(f"^{_ISO.pattern}$") & (text > "0000-12-31"), text.try_cast("date"))
        label = lambda d: F.when(two, F.concat(d["first"], F.lit(" to "), d["last"])).otherwise(d["first"])
        made = lambda d: F.when((d["b"] >= d["a"]) & (d["b"] <= F.lit(LAST_DAY.date())), field("absolute", label(d), start=d["a"], end=F.date_add(d["b"], 1)))
        return _let(F.struct(part(1).alias("first"), part(2).alias("last")), lambda p: _let(F.struct(p["first"].alias("first"), p["last"].alias("last"), day(p["first"]).alias("a"), day(p["last"]).alias("b")), made))

    def of(words: Column) -> Column:
        fixed = F.when(words.isin(*LATEST), field("latest", words)).when(words == "today", field("calendar", "today", unit="day")).when(words == "yesterday", field("calendar", "yesterday", unit="day", offset=-1))
        fixed = fixed.when(words == "this week", field("calendar", "this week", unit="week")).when(words.isin("last week", "past week"), field("rolling", "last week", span=F.lit(int(SPANS["week"].total_seconds()))))
        return F.coalesce(fixed, rolling(words), absolute(words))

    return _let(_words(phrase), of)


def resolved(p: Column, anchor: Column) -> Column:
    """(start, end, label, end_inclusive) of parsed windows at an anchor; the session's zone is UTC. Absolute windows need no anchor."""
    seconds = lambda n: F.make_dt_interval(secs=n)
    day = F.when(p["unit"] == "day", F.date_trunc("day", anchor)).when(p["unit"] == "week", F.date_trunc("week", anchor))
    length = F.when(p["unit"] == "day", 1).when(p["unit"] == "week", 7)
    opens = day + F.make_dt_interval(days=p["offset"] * length)
    start = F.when(p["kind"] == "latest", anchor).when(p["kind"] == "rolling", anchor - seconds(p["span_seconds"])).when(p["kind"] == "absolute", p["start"]).otherwise(opens)
    end = F.when(p["kind"].isin("latest", "rolling"), anchor).when(p["kind"] == "absolute", p["end"]).otherwise(opens + F.make_dt_interval(days=length))
    return F.when(p.isNotNull(), F.struct(start.alias("start"), end.alias("end"), p["label"].alias("label"), p["kind"].isin("latest", "rolling").alias("end_inclusive")))
