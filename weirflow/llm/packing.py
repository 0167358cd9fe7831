"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces longer than half a sequence open one each; the others follow in classes of falling length. In a round the open
pieces of a class and the gaps that may take them are sorted by size. Counts by size, swept upwards, tell which gaps are
the successors of which pieces: a gap goes to the longest piece below it that has none yet. The gaps in their order are
cut into slices of about as many rows, and a piece goes to the slice of its successor; of one size some go here and some
there, by a hash, so neither a common length nor a large table makes a slice large. Each slice is a sweep of its
own: its pieces, the longest first, take the smallest gap that is large enough; of pieces that want the same gap the
first by rank (length, then number) has it, and what is left of the gap is one again at once. Pieces without a gap
are handed on: in the next round they are dealt anew to the slices that have their successors now. Rounds end when
no gap in any slice fits any piece; what then is left opens new sequences, whose gaps the next class finds.
One slice alone does best-fit decreasing; with many, each may leave a sequence part-filled that another could have filled.

Every round is written out, and a sequence is named by the number of the piece that opened it, so recomputation changes
nothing. The driver sees counts by size, at most twice the capacity.

Defined results: null text counts as empty and is the end token alone; a text longer than the capacity is
cut into full pieces and a shorter last one; rows that repeat a doc_id, or have none, are packed each; an empty table
gives no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import materialise, text_of, unit_hash

CAPACITY, END_ID = 4096, 1
#: Rows of a slice, about; ratio of the lengths of a class, and share of the capacity below which all are one.
SLICE_ROWS, CLASS_RATIO, LAST_CLASS = 5_000, 4, 32
#: Words of which a Python worker remembers the ids; beyond it forgets them all.
CACHED = 600_000

# The tokenizer's own split pattern, spelt out for the characters below, whose classes no Unicode version changes.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
_UNUSUAL = "[^\\x00-ſ]|[\\x1c-\\x1fİ]"


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of each of many runs, one after another."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


class WordTokenizer:
    """Token ids of whole texts, equal to the tokenizer's own.

    The tokenizer lower-cases, splits at white space and classes of characters, and merges within words
    only. So the words of many texts are told apart at once by Arrow, each distinct one is looked up once, the tokenizer
    is asked for those not met before, and ids are gathered from one buffer. Texts with characters beyond Latin
    Extended-A, or with control characters on whose class libraries differ, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = "|".join([_UNUSUAL, *specials])
        # For words that are split and in lower case already: the same merges without the steps before them.
        self.merges = Tokenizer.from_file(path)
        self.merges.no_truncation()
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of a word; its ids are a slice of the buffer
        self.start, self.length, self.buffer = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self._add([""], self.buffer, np.zeros(1, np.int64))

    def encode(self, texts: list[str], words: bool = False) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (self.merges if words else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, names: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.start), len(self.start) + len(names)), strict=True))
        self.start = np.concatenate([self.start, len(self.buffer) + np.cumsum(length) - length])
        self.length, self.buffer = np.concatenate([self.length, length]), np.concatenate([self.buffer, ids])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words one after another, and how many each has; by texts of many words: the token that ends a word says so."""
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), 4096):
            own = words[i : i + 4096]
            (data,) = self.encode([" ".join(own)], words=True)
            ends = np.flatnonzero(self.ends_word[data]) + 1
            if len(ends) == len(own) and (not len(ends) or ends[-1] == len(data)):
                ids.append(data)
                lengths.append(np.diff(ends, prepend=0))
            else:
                each = self.encode(own, words=True)
                ids += each
                lengths.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, new: list[str]) -> None:
        """New runs of characters between blanks: words and signs in them are learned first, then those runs that have several."""
        words, others = [r for r in new if r.isalpha()], [r for r in new if not r.isalpha()]
        split = [_SPLIT.findall(r) for r in others]
        own = set(words)
        words += [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.known and w not in own]
        self._add(words, *self._encode_words(words))
        several = [(r, ws) for r, ws in zip(others, split, strict=True) if r not in self.known]
        at = np.array([self.known[w] for _, ws in several for w in ws], np.int64)
        n = np.array([len(ws) for _, ws in several], np.int64)
        ends = np.concatenate([[0], np.cumsum(self.length[at])])
        last = np.cumsum(n)
        self._add([r for r, _ in several], self.buffer[_spread(self.start[at], self.length[at])], ends[last] - ends[last - n])

    def _numbers(self, names: list[str]) -> np.ndarray:
        number = np.array(list(map(self.known.get, names, repeat(-1))), np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            own = [names[i] for i in new]
            self._learn(own)
            number[new] = [self.known[r] for r in own]
        return number

    def batch(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end`` if there is one; and where each text's begin, and the end."""
        if len(self.known) > CACHED:
            self._forget()
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False))
        plain = texts
        if len(odd):
            blank = np.zeros(len(texts), np.bool_)
            blank[odd] = True
            plain = pc.if_else(pa.array(blank), "", texts)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        runs = lists.flatten().dictionary_encode()
        code = self._numbers(runs.dictionary.to_pylist())[runs.indices.to_numpy(zero_copy_only=False)] if len(runs) else np.empty(0, np.int64)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if end is not None:
            if "\0end" not in self.known:
                self._add(["\0end"], np.array([end], np.uint32), np.array([1], np.int64))
            code = np.insert(code, at[1:], self.known["\0end"])
            at = at + np.arange(len(at))
        length = self.length[code]
        ids, ends = self.buffer[_spread(self.start[code], length)], np.concatenate([[0], np.cumsum(length)])[at]
        if not len(odd):
            return ids, ends
        parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i, own in zip(odd, self.encode([texts[int(i)].as_py() for i in odd]), strict=True):
            parts[i] = np.concatenate([own, parts[i]])  # the end, if any
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_TOKENIZERS: dict[str, WordTokenizer] = {}

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        for batch in batches:
            for texts, a, n in _portions(batch.column(1)):
                own = texts.dictionary_encode()  # a text that is there several times is told apart once
                ids, ends = _TOKENIZERS[path].batch(own.dictionary, end_id)
                at = own.indices.to_numpy(zero_copy_only=False)
                tokens, starts = np.diff(ends)[at], ends[at]
                count = -(-tokens // capacity)  # one at least, as each has its end
                row, piece = np.repeat(np.arange(n), count), _spread(np.zeros(n, np.int64), count)
                start = piece * capacity
                length = np.minimum(tokens[row] - start, capacity)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                first = (starts[row] + start) * 4
                crc = [zlib.crc32(view[i:j]) for i, j in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                columns = [batch.column(0).slice(a, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=_PIECES.names)

    return run


def _portions(texts: pa.Array, most: int = 6 << 20) -> Iterator[tuple[pa.Array, int, int]]:
    """The texts in portions of some 6 MB, or of one text: with the number of the first and how many."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield texts.slice(a, b - a), a, b - a
        a = b


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with a number each (node), written out so that numbers stand whatever is lost."""
    made = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).mapInArrow(_tokenise(tokenizer_path, capacity, end_id), _PIECES)
    return materialise(made.withColumn("node", F.monotonically_increasing_id()), "pieces")


#: Kinds of rows of a round: a piece without a place, a gap (size: what is left of the sequence), a piece with its place.
OPEN, GAP, PLACED = 0, 1, 2
_ROWS = T.StructType([*_PIECES.fields, T.StructField("node", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("kind", T.IntegerType())])


def best_fit(lengths: list[int], gaps: list[tuple[int, int]], capacity: int, opening: bool) -> tuple[list[tuple[int, int] | None], list[tuple[int, int]]]:
    """Places for pieces in the order given: (name of the sequence, gap it took) or None; and the gaps left, ascending.

    ``gaps``: (size, name). Where ``opening``, a piece without a gap opens a sequence, named by minus one minus its index.
    """
    free = sorted(gaps)
    places: list[tuple[int, int] | None] = []
    for i, n in enumerate(lengths):
        at = bisect_left(free, (n, -(1 << 62)))
        if at < len(free):
            size, name = free.pop(at)
        elif opening:
            size, name = capacity, -1 - i
        else:
            places.append(None)
            continue
        places.append((name, size))
        if size > n:
            rest = (size - n, name)
            free.insert(bisect_left(free, rest), rest)
    return places, free


def _sweep(capacity: int, opening: bool):
    def run(rows: pa.Table) -> pa.Table:
        own = rows.drop_columns(["slice"])
        is_gap = np.asarray(own.column("kind")) == GAP
        waiting = own.filter(pa.array(~is_gap)).sort_by([("size", "descending"), ("node", "ascending")])
        gaps = own.filter(pa.array(is_gap))
        node = waiting.column("node").to_pylist()
        found, free = best_fit(waiting.column("size").to_pylist(), list(zip(gaps.column("size").to_pylist(), gaps.column("sequence_id").to_pylist(), strict=True)), capacity, opening)
        name = lambda x: x if x >= 0 else node[-1 - x]
        placed = waiting.set_column(6, "sequence_id", pa.array([p and name(p[0]) for p in found], pa.int64()))
        placed = placed.set_column(7, "offset", pa.array([p and capacity - p[1] for p in found], pa.int64()))
        placed = placed.set_column(9, "kind", pa.array([PLACED if p else OPEN for p in found], pa.int32()))
        none = {c: pa.nulls(len(free), placed.schema.field(c).type) for c in placed.column_names}
        none |= {"sequence_id": pa.array([name(x) for _, x in free], pa.int64()), "size": pa.array([n for n, _ in free], pa.int64()), "kind": pa.array([GAP] * len(free), pa.int32())}
        return pa.concat_tables([placed, pa.table(none, schema=placed.schema)])

    return run


def successors(waiting: dict[int, int], gaps: dict[int, int]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Which gaps take which pieces, one each, told from counts by size: (size, first, last, place), where the pieces of a size
    numbered first up to before last take the gaps from ``place`` on in ascending order; and by size how many pieces have none.

    A gap goes to the longest piece that fits and has none yet, so pieces that wait are a stack.
    """
    runs: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []
    at = 0
    for size in sorted({*waiting, *gaps}):
        if size in waiting:
            stack.append((size, waiting[size]))
        end = at + gaps.get(size, 0)
        while stack and at < end:
            own, left = stack.pop()
            n = min(left, end - at)
            runs.append((own, left - n, left, at))
            at += n
            if n < left:
                stack.append((own, left - n))
        at = end
    return runs, dict(stack)


def _sliced(rows: DataFrame, counts: dict[int, dict[int, int]], slices: int) -> tuple[DataFrame, int]:
    """The rows with their slice: gaps by their place in ascending order, pieces where their successor is, those without one anywhere; and how many have one."""
    runs, none = successors(counts[OPEN], counts[GAP])
    table = [(OPEN, size, first, last, place) for size, first, last, place in runs] + [(OPEN, size, 0, n, None) for size, n in none.items()]
    before = 0
    for size in sorted(counts[GAP]):
        table.append((GAP, size, 0, counts[GAP][size], before))
        before += counts[GAP][size]
    whole = [(*r, counts[r[0]][r[1]]) for r in table]
    runs_by_size = rows.sparkSession.createDataFrame(whole, "kind int, size long, first long, last long, place long, whole long")  # at most four times the capacity
    of = F.coalesce("node", "sequence_id")
    number = F.least(F.floor(unit_hash(of, seed=10) * F.col("whole")), F.col("whole") - 1)
    dealt = F.expr(f"(place + number - first) * {slices} div {max(before, 1)}")
    found = rows.join(F.broadcast(runs_by_size), ["kind", "size"]).withColumn("number", number).filter("number >= first AND number < last")
    anywhere = F.least(F.floor(unit_hash(of, seed=11) * slices), F.lit(slices - 1))
    return found.select(*_ROWS.names, F.coalesce(dealt, anywhere).cast("int").alias("slice")), sum(last - first for _, first, last, _ in runs)


def place(made: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of ``made`` (`pieces`) with sequence_id and offset."""
    none = F.lit(None).cast("long")
    waiting = made.select(*_PIECES.names, "node", none.alias("sequence_id"), none.alias("offset"), F.col("length").alias("size"), F.lit(OPEN).alias("kind"))
    long = f"size > {capacity // 2}"
    done = [waiting.filter(long).withColumns({"sequence_id": F.col("node"), "offset": F.lit(0).cast("long"), "kind": F.lit(PLACED)})]
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in _ROWS.fields[:6]]
    gaps = waiting.filter(f"{long} AND size < {capacity}").select(*null, F.col("node").alias("sequence_id"), none.alias("offset"), (capacity - F.col("size")).alias("size"), F.lit(GAP).alias("kind"))
    high = capacity // 2
    while high > 0:
        low = high // CLASS_RATIO if high // CLASS_RATIO * LAST_CLASS >= capacity else 0
        own, opening, before = waiting.filter(f"size > {low} AND size <= {high}"), False, None
        while not opening:
            counts: dict[int, dict[int, int]] = {OPEN: {}, GAP: {}}
            for r in own.unionByName(gaps.filter(f"size > {low}")).groupBy("kind", "size").agg(F.count("*").alias("n")).collect():
                counts[r.kind][r.size] = r.n
            n, least = sum(counts[OPEN].values()), min(counts[OPEN], default=0)
            if not n:
                break
            counts[GAP] = {size: k for size, k in counts[GAP].items() if size >= least}
            slices = -(-(n + sum(counts[GAP].values())) // slice_rows)
            dealt, fitting = _sliced(own.unionByName(gaps.filter(f"size >= {least}")), counts, slices)
            opening = slices == 1 or not fitting or n == before
            made_now = materialise(dealt.groupBy("slice").applyInArrow(_sweep(capacity, opening), _ROWS), "round")
            done.append(made_now.filter(F.col("kind") == PLACED))
            gaps = gaps.filter(f"size < {least}").unionByName(made_now.filter(F.col("kind") == GAP))
            own, before = made_now.filter(F.col("kind") == OPEN), n
        high = low
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select(*_PIECES.names, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, tokenizer_path, capacity, end_id), capacity)
