"""Similarity join of documents on word shingles by parity sketches.

Each shingle of a set flips one bit of a long sketch, so the Hamming distance of two sketches is at most the
number of shingles in which the sets differ. At a Jaccard similarity of t or more, two sets of a and b
shingles differ in at most d = (1 - t) / (1 + t) * (a + b). Within a band of sizes all sketches are cut into
the same m blocks, more than d, so at least m - d of the blocks agree. If every document lists its blocks in
one global order (fuller ones first, so that empty blocks and those of one shingle come last), two that are
linked share one of the first d + 1. Documents meet on these, with d from their own sizes, and only there.
A block is known by a linear hash of its odd bits; to compare whole sketches their bits are folded into about
as many as the set has shingles, which still bounds the difference from below.

Equal sets are one class from the start, a class is a node. Keys are sorted
over all partitions, so that a bucket of any size is spread over as many as it fills, and each class first
meets the first of its bucket there and the one before it, which ties groups of near copies together with
links in proportion to their size. Then, in buckets that still hold several
components, the pairs across components are looked at in blocks of bounded size: sizes and sketches rule out
nearly all, what is left is verified on the shingles. That is done for the closest pair of every two components of a
bucket first, then for all pairs of components that are apart still. No pair is skipped but those inside a component,
which cannot change the result.

Defined results: null, empty and blank texts have no shingles and no links, their component is their doc_id;
a text with fewer words than a shingle has one shingle, all its words; equal sets are linked; rows that
repeat a doc_id are rows of their own, each with the component of its text; rows with a null doc_id take
part like any others, but a component is named by the smallest doc_id in it that is not null, and only a
component without one has a null name; an empty table gives no rows; further columns of the input are
ignored, whatever their names. `drop_similar` leaves one row of each component: of the smallest doc_id (null
last), then of the least digest, then the least by all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import keep_rows, keyed_join, materialise, release, row_keys, text_of
from weirflow.llm.components import components

#: Ratio of the sizes of neighbouring bands; blocks of a sketch for each difference that is allowed; members of a bucket that one task compares at once.
BAND_RATIO, BLOCKS, BLOCK_ROWS = 2.0, 1.25, 1024
#: Words whose hashes a worker keeps while it reads a partition.
CACHED_WORDS = 200_000

_MIX_A, _MIX_B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes. Only A-Z is lower-cased, only ASCII white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    m = len(w) - width + 1
    h = w[:m] + np.uint64(width)
    for j in range(1, width):
        h = h * _MIX_A + w[j : m + j]
        h ^= h >> np.uint64(29)
        h *= _MIX_B
    h ^= h >> np.uint64(32)
    h *= _MIX_A
    return np.unique(h ^ (h >> np.uint64(31)))


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``percent`` / 100 on shingles of ``width`` words."""

    width: int = 5
    percent: int = 80

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def most_apart(self, total: int) -> int:
        """Greatest symmetric difference of two linked sets of together ``total`` shingles."""
        return (100 - self.percent) * total // (100 + self.percent)

    @cache
    def bands(self) -> np.ndarray:
        """The least size of each band."""
        least = [1]
        while least[-1] < 1 << 40:
            least.append(max(least[-1] + 1, int(least[-1] * BAND_RATIO)))
        return np.array(least, np.int64)

    @cache
    def blocks_in(self, band: int) -> int:
        """Blocks of a sketch in this band, each folded into a word of 64 bits; 0 where linked sets are equal."""
        apart = self.most_apart(2 * int(self.bands()[band + 1] - 1))
        return int(BLOCKS * apart) + 1 if apart else 0

    def keys_in(self, size: int, band: int) -> int:
        """How many blocks a set of this size lists in this band: one more than it can differ in from a partner there."""
        return self.most_apart(size + min(int(self.bands()[band + 1] - 1), 100 * size // self.percent)) + 1

    def bands_of(self, size: int) -> list[int]:
        """The band of a size, and those above it in which the larger partner of a link can be."""
        band = int(np.searchsorted(self.bands(), size, side="right")) - 1
        found = [band]
        while self.percent * int(self.bands()[found[-1] + 1]) <= 100 * size:
            found.append(found[-1] + 1)
        return [b for b in found if self.blocks_in(b)]

    def sketch(self, shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """For each block its bits folded into a word, and a hash of its place and its odd bits, which are 2**32 a block."""
        n = self.blocks_in(band)
        at = ((shingles >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # ascends with the hash
        starts = np.flatnonzero(np.diff(at, prepend=np.uint64(n)))
        filled = at[starts].astype(np.int64)
        words, odd = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        words[filled] = np.bitwise_xor.reduceat(np.uint64(1) << (shingles & np.uint64(63)), starts)
        odd[filled] = np.bitwise_xor.reduceat(_mixed((shingles & np.uint64(0xFFFFFFFF)) + np.uint64(1)), starts)
        return words, _mixed(odd + (np.arange(n, dtype=np.uint64) << np.uint64(8)) + np.uint64(band))

    def listed(self, size: int, band: int, words: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The names of the blocks that come first: fuller ones before others, then by name; blocks that tie with the last are in."""
        n = min(self.keys_in(size, band), len(names))
        order = (np.uint64(64) - np.bitwise_count(words)) << np.uint64(56) | names >> np.uint64(8)
        return names[order <= np.partition(order, n - 1)[n - 1]]

    def folded(self, words: np.ndarray, band: int) -> np.ndarray:
        """A shorter sketch, each of its words the exclusive or of some of the words."""
        n = min(len(words), max(2, -(-int(self.bands()[band + 1]) // 64)))
        padded = np.zeros(-(-len(words) // n) * n, np.uint64)
        padded[: len(words)] = words
        return np.bitwise_xor.reduce(padded.reshape(-1, n), axis=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX_A
    x ^= x >> np.uint64(29)
    x *= _MIX_B
    return x ^ (x >> np.uint64(32))


#: A row's place in its input isn't known here; ``node`` is added when the rows are written.
_SKETCHES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
    T.StructField("sketches", T.ArrayType(T.StructType([T.StructField("band", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))]))),
    T.StructField("lists", T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("names", T.ArrayType(T.LongType()))]))),
])
_SKETCH_KIND = pa.list_(pa.struct([("band", pa.int32()), ("words", pa.list_(pa.int64()))]))
_LIST_KIND = pa.list_(pa.struct([("code", pa.int64()), ("names", pa.list_(pa.int64()))]))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)))


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _let_go() -> None:
    """Give memory back: workers live on between stages, and idle ones count, too."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()


def _sketch(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sizes, digests, bands, codes, folded, names, per_row = [], [], [], [], [], [], [0]
                for text in part.column(2):
                    s = shingle_set(text.as_py(), sim.width)
                    sizes.append(len(s))
                    digests.append(_digest(s))
                    for band in sim.bands_of(len(s)) if len(s) else ():
                        words, own = sim.sketch(s, band)
                        bands.append(band)
                        codes.append(256 * len(s) + band)
                        folded.append(sim.folded(words, band))
                        names.append(sim.listed(len(s), band, words, own))
                    per_row.append(len(bands))
                ends = pa.array(per_row, pa.int32())
                sketches = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(bands, pa.int32()), _lists(folded)], ["band", "words"])).cast(_SKETCH_KIND)
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(codes, pa.int64()), _lists(names)], ["code", "names"])).cast(_LIST_KIND)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketches, lists], names=_SKETCHES.names)
        _let_go()

    return run


_SETS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), width) for t in batch.column(0).slice(a, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], names=_SETS.names)
        _let_go()

    return run


_MET = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("hub", T.LongType()),
    T.StructField("previous", T.LongType()), T.StructField("edge", T.BooleanType()),
])


def _runs(sim: Similarity):
    """Of rows sorted by key and node those that share their key, with the first of the run in this partition and the
    one before, where their sizes allow a link (else the node itself); and the partition's first and last row, whose
    runs may go on in its neighbours. One row is held back."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def made(columns: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=_MET.names)

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= sim.percent * np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key, code, document, hub and its size, the one before and its size, in a run, edge
        for batch in batches:
            key, code, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            if held:
                key, code, doc = (np.concatenate([[h], x]) for h, x in zip(held[:3], (key, code, doc), strict=True))
            same = np.zeros(len(key), np.bool_)
            same[1:] = key[1:] == key[:-1]
            group, size = np.cumsum(~same) - 1, code >> 8
            first = np.flatnonzero(~same)
            hub, hub_size = doc[first][group], size[first][group]
            before, before_size = (np.where(same, np.concatenate([x[:1], x[:-1]]), x) for x in (doc, size))
            inside, edge = same.copy(), np.zeros(len(key), np.bool_)
            inside[:-1] |= same[1:]
            if held:
                hub[group == 0], hub_size[group == 0], before[0], before_size[0] = held[3:7]
                inside[0] |= held[7]
            edge[0] = held[8] if held else True
            keep = np.flatnonzero((inside | edge)[:-1])
            shown = np.where(edge | allowed(size, hub_size), hub, doc)
            yield made(tuple(x[keep] for x in (key, code & 255, doc, shown, np.where(allowed(size, before_size), before, doc), edge)))
            held = (*(x[-1] for x in (key, code, doc, hub, hub_size, before, before_size)), bool(inside[-1]), bool(edge[-1]))
        if held:
            yield made(([held[0]], [held[1] & 255], [held[2]], [held[3]], [held[5]], [True]))

    return run


def _by_band(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, n_shingles, band, words) of the nodes in ``ids``."""
    return keyed_join(reps.select("node", "n_shingles", "sketches"), ids, ["node"], "left_semi").select("node", "n_shingles", F.explode("sketches").alias("s")).select("node", "n_shingles", "s.band", "s.words")


def _close(pairs: DataFrame, reps: DataFrame, sim: Similarity) -> DataFrame:
    """Those of ``pairs`` (a, b, band) whose sizes and sketches allow a link; the distance of sketches is at most that of the sets."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met_ids")
    sketches = materialise(_by_band(reps, ids), "met_sketches")
    for side in ("a", "b"):
        own = sketches.select(F.col("node").alias(side), "band", F.col("n_shingles").alias(f"n_{side}"), F.col("words").alias(f"w_{side}"))
        pairs = pairs.join(own, [side, "band"])
    apart = F.expr("aggregate(zip_with(w_a, w_b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    near = f"100 * least(n_a, n_b) >= {sim.percent} * greatest(n_a, n_b)"
    close = pairs.filter(near).filter(apart * (100 + sim.percent) <= (100 - sim.percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
    out = materialise(close, "close")
    release(ids, sketches)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, sim: Similarity) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked. Shingles are made anew for the nodes concerned alone, from the rows with their doc_id and text."""
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    known = keyed_join(reps.select("node", "doc_id", "sha", "digest"), nodes, ["node"], "left_semi")
    known = materialise(known.select("node", "digest", *[c.alias(n) for n, c in row_keys(known, F.col("sha")).items()]), "known")
    rows = docs.select("text", *[c.alias(n) for n, c in row_keys(docs, F.col("sha")).items()])
    keys = ["_wf_null", "_wf_id", "_wf_sha"]
    sets = keyed_join(rows, known.select(*keys), keys, "left_semi").select("text").mapInArrow(_sets(sim.width), _SETS).dropDuplicates(["digest"])
    sets = materialise(sets.join(known.select("node", "digest"), "digest").select("node", "shingles"), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    common = F.size(F.array_intersect("s_a", "s_b"))
    linked = materialise(pairs.filter(100 * common >= sim.percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b").distinct(), "linked")
    release(nodes, known, sets)
    return linked


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_KEYED = T.StructType([*_PAIRS, T.StructField("key", T.LongType())])


def _across(sim: Similarity, closest: bool = False):
    """Pairs of different components of a bucket's members whose sizes and sketches allow a link, or of two components the
    ``closest`` pair alone by its sketches, with the bucket's key; members come bucket by bucket."""

    def pairs(node: np.ndarray, comp: np.ndarray, block: np.ndarray, n: np.ndarray, words: np.ndarray, within: bool) -> Iterator[np.ndarray]:
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        order = np.argsort(n, kind="stable")
        node, comp, block, n, words = node[order], comp[order], block[order], n[order], words[order]
        reach = np.searchsorted(n, n * 100 // sim.percent, side="right")  # partners that are no smaller
        for a in range(0, len(n) - 1, 32):
            b, end = min(a + 32, len(n)), int(reach[min(a + 32, len(n)) - 1])
            i, j = np.arange(a, b)[:, None], np.arange(a, end)[None, :]
            ok = (j > i) & (j < reach[i]) & (comp[i] != comp[j])
            if not within:
                ok &= block[i] != block[j]
            if ok.any():
                x, y = np.nonzero(ok)
                x, y = x + a, y + a
                apart = np.zeros(len(x), np.int64)
                for c in range(0, len(x), 4096):
                    apart[c : c + 4096] = np.bitwise_count(words[x[c : c + 4096]] ^ words[y[c : c + 4096]]).sum(axis=1, dtype=np.int64)
                near = apart * (100 + sim.percent) <= (100 - sim.percent) * (n[x] + n[y])
                x, y, apart = x[near], y[near], apart[near]
                if not closest:
                    yield np.sort(np.stack([node[x], node[y]], axis=1), axis=1)
                    continue
                share, lo, hi = apart / (n[x] + n[y]), np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
                by = np.lexsort((share, hi, lo))
                by = by[np.flatnonzero((np.diff(lo[by], prepend=-1) != 0) | (np.diff(hi[by], prepend=-1) != 0))]
                for two, found in zip(zip(lo[by].tolist(), hi[by].tolist(), strict=True), zip(share[by].tolist(), node[x[by]].tolist(), node[y[by]].tolist(), strict=True), strict=True):
                    best[two] = min(best.get(two, found), found)
        if best:
            yield np.sort(np.array([b[1:] for b in best.values()], np.int64), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _then_none(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, new]) if held is not None else new
            if held is None or not held.num_rows:
                continue
            bucket = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(bucket)]
            if batch is not None:
                starts, ends, rest = starts[:-1], ends[:-1], held.slice(int(starts[-1]))
            out = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    own = held.slice(a, b - a)
                    ids = [own.column(c).to_numpy() for c in ("node", "component", "block", "n_shingles")]
                    words = own.column("words").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(b - a, -1)
                    for two in pairs(*ids, words, bucket[a, 1] == bucket[a, 2]):
                        out.append(np.column_stack([two, np.full(len(two), bucket[a, 0])]) if closest else two)
            if out and len(found := np.concatenate(out)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], names=(_KEYED if closest else _PAIRS).names)
            held = rest if batch is not None else None

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _untied(met: DataFrame, tied: DataFrame, reps: DataFrame, sim: Similarity, closest: bool = False) -> DataFrame:
    """Candidate pairs across components in buckets that hold more than their hubs have settled, all of them or the closest of every two components of a bucket, with its key."""
    now = keyed_join(met, tied, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi AND n > 2")
    mixed = materialise(mixed.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "mixed")
    if mixed.isEmpty():
        return mixed.sparkSession.createDataFrame([], _KEYED if closest else _PAIRS)
    members = materialise(keyed_join(now, mixed, ["key"], "inner"), "members")
    concerned = materialise(members.select("node").distinct(), "concerned")
    sketches = _by_band(reps, concerned)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(sketches, ["node", "band"])
    )
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return runs.select("key", "i", "j", "node", "component", "block", "n_shingles", "words").mapInArrow(_across(sim, closest), _KEYED if closest else _PAIRS).distinct()


def _grouped(docs: DataFrame, sim: Similarity) -> DataFrame:
    """One row per document: doc_id, sha (of the text), n_shingles, and the component, a number that is null for a document without links."""
    docs = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    made = materialise(docs.mapInArrow(_sketch(sim), _SKETCHES).withColumn("node", F.monotonically_increasing_id()), "sketches")
    classes = made.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("digest", "rep")
    classes = materialise(classes, "classes")
    reps = keyed_join(made.filter("digest IS NOT NULL"), classes, ["digest"], "left").filter("rep IS NULL OR rep = node")
    keys = reps.select("node", F.explode("lists").alias("l")).select("node", "l.code", F.explode("l.names").alias("key")).select("key", "code", "node")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(keys.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node").mapInArrow(_runs(sim), _MET), "met")
    reps = materialise(reps.select("node", "doc_id", "sha", "digest", "n_shingles", "sketches"), "reps")
    rows = materialise(made.select("node", "doc_id", "sha", "digest", "n_shingles"), "rows")
    release(made)
    edges = met.filter("edge").select("key", "band", F.col("hub").alias("node")).distinct()  # at most two rows of a partition
    across = keyed_join(edges, materialise(edges.groupBy("key").agg(F.min("node").alias("hub")), "edges"), ["key"], "inner").select("band", "node", "hub")
    hubs = met.select("band", "node", F.explode(F.array("hub", "previous")).alias("hub")).unionByName(across).filter("node <> hub")
    hubs = hubs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.min("band").alias("band"))
    hubs = materialise(hubs, "hubs")
    links = [_verified(_close(hubs, reps, sim), docs, reps, sim)]
    tied, seen, spare = components(links[0]), [hubs], []
    buckets = met.select("key", "band", "node")
    for closest in (True, False):
        found = materialise(_untied(buckets, tied, reps, sim, closest), "found")
        seen.append(found)
        if found.isEmpty():
            break
        more = materialise(reduce(lambda left, old: left.join(old, ["a", "b"], "left_anti"), seen[:-1], found.select("a", "b").distinct()), "more")
        seen.append(more)
        if not more.isEmpty():
            links.append(_verified(more, docs, reps, sim))
            tied = components(reduce(DataFrame.unionByName, links))
        if closest:  # a bucket without any pair now has none later, as components only grow
            still_open = materialise(found.select("key").distinct(), "open")
            buckets = keyed_join(buckets, still_open, ["key"], "left_semi")
            spare.append(still_open)
    release(met, reps, *seen, *spare, *links)
    out = keyed_join(rows, classes, ["digest"], "left").select("doc_id", "sha", "n_shingles", "rep", F.coalesce("rep", "node").alias("node"))
    return keyed_join(out, tied, ["node"], "left").select("doc_id", "sha", "n_shingles", F.coalesce("component", "rep").alias("component"))


def similar_groups(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    found = materialise(_grouped(docs, sim).select("doc_id", "n_shingles", "component"), "grouped")
    least = materialise(found.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    named = keyed_join(found, least, ["component"], "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_similar(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The documents, of each component of near copies one row only."""
    found = _grouped(docs, sim).filter("component IS NOT NULL")
    found = materialise(found.select("component", *[c.alias(n) for n, c in row_keys(found, F.col("sha")).items()]), "grouped")
    key = F.struct("_wf_null", "_wf_id", "_wf_sha")
    best = materialise(found.groupBy("component").agg(F.min(key).alias("best")), "best")
    decided = keyed_join(found, best, ["component"], "inner").withColumn("_wf_kept", key == F.col("best"))
    decided = decided.groupBy("_wf_null", "_wf_id", "_wf_sha").agg(F.first("_wf_kept").alias("_wf_kept"), F.count("*").alias("_wf_n"))
    return keep_rows(docs, F.sha2(text_of(docs), 256), materialise(decided, "decided"))
