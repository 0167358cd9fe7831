"""Exact deduplication by recipes of content-defined chunks.

A document's normalised text is cut where a rolling hash of its last bytes meets a fixed pattern, so equal
passages give equal chunks wherever they stand. A chunk is known by a 64-bit hash, which is *verified* by
its SHA-256: where two different chunks share the short hash they get different identifiers. A document
then is the ordered list of its chunk identifiers, and documents are equal when their lists are. Texts
are read once and never shuffled: 40 bytes a chunk move for verification, 8 bytes a chunk for comparison.

Defined results: null text counts as empty, and all empty texts are one group; rows that repeat a doc_id
are members of their group and are marked alike in `exact_groups`, while `drop_copies` leaves one row of a
group; a null doc_id never stays if its group has another; further columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import keep_rows, keyed_join, materialise, row_keys, text_of

#: Bytes: the window of the rolling hash, and the least, expected and greatest length of a chunk.
WINDOW, LEAST, EXPECTED, MOST = 48, 256, 1024, 8192

_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space replaced by one space."""
    s = (text or "").encode("utf-8", "surrogatepass").translate(_BLANKS)
    while b"  " in s:
        s = s.replace(b"  ", b" ")
    return s


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as the longest text so far needs."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 16, 1 << (n - 1).bit_length())
            ones = np.full(self.n, 1, np.uint64)
            ones[1:] = _BASE
            self.up = np.multiply.accumulate(ones)
            ones[1:] = _UNBASE
            self.down = np.multiply.accumulate(ones)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: ascending, the last is its length; none for no data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    up, down = _POWERS.to(n)
    summed = np.cumsum(_BYTE_VALUES[np.frombuffer(data, np.uint8)] * down, dtype=np.uint64)
    summed[WINDOW:] -= summed[:-WINDOW].copy()
    ends = (np.flatnonzero((summed * up) >> np.uint64(64 - EXPECTED.bit_length() + 1) == 0) + 1).tolist()
    cuts, last = [], 0
    for e in [*ends, n]:
        while e - last > MOST:
            last += MOST
            cuts.append(last)
        if e - last >= LEAST or e == n and e > last:
            cuts.append(e)
            last = e
    return cuts


_RECIPES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_sha256", T.StringType()),
    T.StructField("short", T.ArrayType(T.LongType())), T.StructField("proof", T.ArrayType(T.BinaryType())),
])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    for batch in batches:
        digests, short, proof = [], [], []
        for text in batch.column(1):
            data, at = normalise(text.as_py()), 0
            digests.append(hashlib.sha256(data).hexdigest())
            a, b = [], []
            for end in cut_points(data):
                part, at = data[at:end], end
                a.append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                b.append(hashlib.sha256(part).digest())
            short.append(a)
            proof.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (digests, short, proof), kinds[1:])], names=_RECIPES.names)


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, and the ordered list of verified chunk identifiers."""
    raw = materialise(docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(_recipes, _RECIPES), "recipes")
    chunks = raw.select(F.explode(F.arrays_zip("short", "proof")).alias("c")).select("c.short", "c.proof").distinct()
    shared = chunks.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").select("short")
    # A short hash with two proofs is expected once in 2**32 chunks or so; what few there are get numbers.
    clash = materialise(chunks.join(shared, "short").select("short", "proof"), "clash")
    if clash.isEmpty():
        return raw.select("doc_id", "text_sha256", F.col("short").alias("recipe"))
    return renumbered(raw, clash)


def renumbered(raw: DataFrame, clash: DataFrame) -> DataFrame:
    """The lists of ``raw`` with a new identifier, from its proof, for each chunk of ``clash``."""
    own = clash.distinct().withColumn("own", F.xxhash64("proof", F.lit(1)))
    row = raw.withColumn("row", F.monotonically_increasing_id())
    row = materialise(row, "rows")
    parts = row.select("row", F.posexplode(F.arrays_zip("short", "proof")).alias("at", "c")).select("row", "at", "c.short", "c.proof")
    lists = (
        keyed_join(parts, own, ["short", "proof"], "left")
        .groupBy("row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("own", "short").alias("id")))), lambda x: x.id).alias("recipe"))
    )
    return row.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", F.array().cast("array<bigint>")).alias("recipe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (the smallest doc_id with an equal text), group_size, kept, text_sha256, n_chunks.

    Groups are counted with a partial aggregation, so a group of a third of all rows reaches no task
    whole; the SHA-256 of the whole text stands in the key as an exact check after the recipes.
    """
    lists = materialise(recipes(docs), "lists")
    groups = lists.groupBy("text_sha256", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(groups.filter("group_size > 1"), "groups")
    out = lists.join(groups, ["text_sha256", "recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of equal texts, that with the smallest doc_id (a null one only if there is no other).

    Rows go by doc_id and digest of the text, nulls included. Where the row that stays is there several times the
    least of these by all columns stays.
    """
    copies = exact_groups(docs).filter("group_size > 1")
    keys = row_keys(copies, F.col("text_sha256"))
    decided = copies.select("kept", *[c.alias(n) for n, c in keys.items()]).groupBy(*keys).agg(F.first("kept").alias("_wf_kept"), F.count("*").alias("_wf_n"))  # kept is the same for a key
    normal = F.sha2(F.regexp_replace(text_of(docs), r"[\x20\x09-\x0D]+", " "), 256)
    return keep_rows(docs, normal, materialise(decided, "copies"))
