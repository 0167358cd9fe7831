"""Points inside intervals by an equi-join on time bins, so that no key has to hold a whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def within(points: DataFrame, windows: DataFrame, by: list[str], start: str, end: str, at: str = "at", width_ms: int = DAY_MS, end_inclusive: str | None = None) -> DataFrame:
    """Points joined with every window of the same ``by`` that they lie in.

    A window is a row for each bin of ``width_ms`` that it touches, a point has one bin: they meet on (by, bin), and the
    interval is the residual condition, so every pair comes out once. A hot key is as many keys as it has bins, and a
    point is compared only with windows that touch its bin. Windows should not be much longer than a few hundred bins.
    Ends are included unless ``end_inclusive``, a boolean column of the windows, says otherwise. Windows that end before
    they start, and rows with nulls in a key or a time, meet nothing. They meet in sorted parts, since how many bins the
    windows have isn't in the estimate of their size, by which they could be sent whole through the driver.
    """
    bin_of = lambda c: F.floor(F.unix_millis(c) / width_ms)
    w = windows.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))))
    upper = F.col(at) <= F.col(end) if end_inclusive is None else F.when(F.col(end_inclusive), F.col(at) <= F.col(end)).otherwise(F.col(at) < F.col(end))
    joined = points.withColumn("_bin", bin_of(F.col(at))).join(w.hint("merge"), [*by, "_bin"])
    return joined.filter((F.col(at) >= F.col(start)) & upper).drop("_bin")
