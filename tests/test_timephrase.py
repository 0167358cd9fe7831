from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weirflow.functions import timephrase as T

AT = datetime(2026, 8, 5, 14, 30, tzinfo=timezone.utc)  # a Wednesday


@pytest.mark.parametrize(("phrase", "days"), [("last 3 days", 3), ("past 2 weeks", 14), ("last week", 7), ("previous month", 30), ("last year", 365), ("  LAST   1 day ", 1)])
def test_rolling(phrase, days):
    r = T.resolve(T.parse(phrase), AT)
    assert (r.start, r.end, r.end_inclusive) == (AT - timedelta(days=days), AT, True)


def test_calendar_and_absolute():
    day = AT.replace(hour=0, minute=0)
    assert T.resolve(T.parse("today"), AT) == T.ResolvedRange(day, day + T.DAY, "today", False)
    assert T.resolve(T.parse("yesterday"), AT).start == day - T.DAY
    assert T.resolve(T.parse("this week"), AT).start == datetime(2026, 8, 3, tzinfo=timezone.utc)
    r = T.resolve(T.parse("2026-01-01 to 2026-01-02"), AT)
    assert (r.end - r.start, r.end_inclusive) == (2 * T.DAY, False)
    assert T.resolve(T.parse("2026-01-01"), AT).end == datetime(2026, 1, 2, tzinfo=timezone.utc)
    r = T.resolve(T.parse("latest"), AT)
    assert r.start == r.end == AT and r.end_inclusive


@pytest.mark.parametrize("phrase", ["", "  ", "2026-02-30", "2026-8-5", "2026-01-02 to 2026-01-01", "last 0 days", "this month", "whenever"])
def test_rejected(phrase):
    with pytest.raises(T.PhraseError):
        T.parse(phrase)


def test_ladder():
    assert T.rung(timedelta(hours=2)) == T.DAY and T.rung(timedelta(days=4000)) == timedelta(days=365)
    assert T.wider(T.DAY) == timedelta(days=7) and T.wider(timedelta(days=365)) is None
    assert T.look_back(T.parse("last 2 days"), AT, AT + T.DAY) == timedelta(days=3)


@given(st.integers(1, 500), st.sampled_from(["hour", "day", "week", "month", "year"]))
def test_any_rolling(n, unit):
    p = T.parse(f"last {n} {unit}s")
    assert p.span == n * T.SPANS[unit] and p.label == f"last {n} {unit}{'s' * (n != 1)}"
