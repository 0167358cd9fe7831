"""Streams of samples and of text. Batch and stream agree where no row is later than the watermark; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirflow.functions.text import CommentaryFilter, sse_frames
from weirflow.operators.report import RHYTHMS, outside, with_pattern


def tumbling(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, min, max and count of valid samples by epoch-aligned bucket."""
    s = samples.filter("valid AND value IS NOT NULL").withWatermark("at", late)
    made = s.groupBy("device", "metric", F.window("at", width).alias("w")).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return made.select("device", "metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "min", "max", "n")


def distinct(samples: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each reading once, also if it is sent again within the watermark."""
    return samples.withWatermark("at", late).dropDuplicatesWithinWatermark(["device", "metric", "at"])


def excursion_sessions(samples: DataFrame, gap: str = "2 hours", late: str = "4 hours") -> DataFrame:
    """Sessions of readings outside the baseline that last an hour or more; a session ends after a gap without any."""
    out = samples.filter("value < baseline_min OR value > baseline_max").withWatermark("at", late)
    s = out.groupBy("site", "metric", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("window_start"), F.max("at").alias("window_end"), F.count("*").alias("n"))
    return s.filter("window_end - window_start >= interval 1 hour").drop("w")


#: Least length of an excursion, in microseconds.
HOUR_US = 3_600_000_000


class _Runs(StatefulProcessor):
    """The runs of one series: samples wait until the watermark has passed them, so they are taken in the order of their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, ord long, out boolean")
        self.run = handle.getValueState("run", "window_start long, window_end long, going boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [t for b in rows for t in b[["us", "ord", "out"]].itertuples(index=False, name=None) if t[0] > passed]
        if fresh:
            self.waiting.appendList([(int(us), int(n), bool(out)) for us, n, out in fresh])
            self._wake(min(us for us, _, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(t) for t in self.waiting.get())
        due, later = [t for t in waiting if t[0] <= passed], [t for t in waiting if t[0] > passed]
        if not due:
            return
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        start, end, going = self.run.get() if self.run.exists() else (0, 0, False)
        found: dict[int, tuple[int, bool]] = {}
        for us, _, out in due:
            if out:
                start, end = (start, us) if going else (us, us)
                if end - start >= HOUR_US:
                    found[start] = (end, False)
            elif going and end - start >= HOUR_US:
                found[start] = (end, True)
            going = out
        self.run.update((start, end, going))
        if found:
            yield pd.DataFrame([(key[0], key[1], a, b, done) for a, (b, done) in found.items()], columns=["site", "metric", "window_start", "window_end", "ended"])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def excursion_runs(samples: DataFrame, late: str = "4 hours") -> DataFrame:
    """`report.excursions` as a stream: runs of consecutive samples outside the baseline that last an hour or more; no gap in time ends a run.

    ``samples``: site, metric, at, ord, value, baseline_min, baseline_max, and a pattern if it is known. A row says what is known of
    a run: site, metric, window_start, window_end, ended. A run that goes on is told again when it has grown, with ended
    false, so the last row of each window_start is the batch's window over all samples that the watermark has passed.
    Samples that come after the watermark has passed them are dropped; ones that tie in time go by ``ord``. A series keeps the
    samples ahead of the watermark and one run. Needs a state store with timers (RocksDB), and update mode.
    """
    s = with_pattern(samples).filter(F.col("value").isNotNull() & F.col("baseline_min").isNotNull() & F.col("at").isNotNull() & ~F.col("pattern").isin(*RHYTHMS))
    s = s.withWatermark("at", late).select("site", "metric", "at", F.unix_micros("at").alias("us"), F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), F.coalesce(outside(), F.lit(False)).alias("out"))
    shape = T.StructType([s.schema["site"], s.schema["metric"], T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType()), T.StructField("ended", T.BooleanType())])
    made = s.groupBy("site", "metric").transformWithStateInPandas(statefulProcessor=_Runs(), outputStructType=shape, outputMode="Update", timeMode="EventTime")
    return made.select("site", "metric", F.timestamp_micros("window_start").alias("window_start"), F.timestamp_micros("window_end").alias("window_end"), "ended")


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, n = state.get if state.exists else (None, 0)
    for b in batches:
        n += len(b)
        top = b["at"].max()
        at = top if at is None or top > at else at
    state.update((at, n))
    yield pd.DataFrame({"device": [key[0]], "last_at": [at], "readings": [n]})


def freshness(samples: DataFrame) -> DataFrame:
    """The newest reading and the number of readings of each device so far, updated as they come."""
    shape, kept = "device long, last_at timestamp, readings long", "last_at timestamp, readings long"
    return samples.select("device", "at").groupBy("device").applyInPandasWithState(_newest, shape, kept, "update", GroupStateTimeout.NoTimeout)


#: How long a conversation may be silent before its text counts as ended.
SILENCE_MS = 3_600_000
_STATE = "buffer string, depth int, held string, undecided string, after_blank boolean, skips_blanks boolean, removed boolean, started boolean"


def _clean(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    buffer, *fields = state.get if state.exists else ("",)
    f = CommentaryFilter(*fields)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"conv_id": [key[0]], "text": [f.flush()]})
        return
    rows = pd.concat(list(batches)).sort_values("ord")
    out, ended = [], False
    for piece, last in zip(rows["piece"], rows["last"], strict=True):
        frames, buffer = sse_frames(buffer + piece)
        out += [f.push(x) for x in frames]
        if last:
            out.append(f.flush())
            f, buffer, ended = CommentaryFilter(), "", True
        else:
            ended = False
    if ended:
        state.remove()
    else:
        state.update((buffer, *astuple(f)))
        state.setTimeoutDuration(SILENCE_MS)
    yield pd.DataFrame({"conv_id": [key[0]], "text": ["".join(out)]})


def clean_text(pieces: DataFrame) -> DataFrame:
    """Server-sent pieces (conv_id, ord, piece, last) as text without leaked commentary; what is sure comes out at once.

    The state of a conversation is a few characters; it goes with the last piece, or after an hour of silence.
    """
    return pieces.groupBy("conv_id").applyInPandasWithState(_clean, "conv_id long, text string", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
