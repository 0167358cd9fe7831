"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of characters is a closed syncmer if the least of its s-mers (by hash) is the first or the last of
them. Whether it is depends on the k-mer alone, so an edit changes no anchors but those it touches. The
fingerprint has all anchors in the order of the text, repeated ones too: of each 24 bits of its hash and the
distance to the next one, in hex, so it grows with the text and shared passages are equal runs. Texts are
matched by position: a place of one matches a place of the other where two anchors that follow each other are
the same and as far apart. The likeness of two fingerprints is the Jaccard similarity of their sets of such pairs.

`with_neighbours` also needs the next document by descending doc_id. Rows are cut at quantiles of the id into
buckets, within an id that many rows share (or that is null) by a hash of the text, each bucket gets a copy of
the first row of the next one, and a window within buckets finds the neighbour: texts move once, and no task
sees more than some buckets. The edited text shares its head with the text, so only anchors of its tail are
computed anew.

Defined results: null text counts as empty; an empty text has the empty fingerprint, which is like itself
(1) and nothing else (0); a text without an anchor has the hash of its whole as its fingerprint, and a text of
one anchor is matched by that; rows that repeat a doc_id are ordered by a hash of their text; a null doc_id
comes last; the document after the last is the first, a lone document its own neighbour; an empty table gives
no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import bucket_of, let, longs, text_of

#: Length of a k-mer and of an s-mer (a k-mer has WIDTH of them).
K, S = 28, 9
WIDTH = K - S + 1
#: Buckets of ids per shuffle partition.
PER_PARTITION = 4
#: Distances of anchors are told up to this; the last anchor of a text has it too.
FAR = 255

_HASH, _PLACE = 0xFFFFFF, 1 << 38


def s_mers(text: Column) -> Column:
    """A hash of every s-mer of the text. Each match takes one code point and looks at the s-mer it starts, so places are counted in code points whatever the characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda x: F.xxhash64(x))


def anchors(text: Column) -> Column:
    """The closed syncmers of the text in order: of each 24 bits of its hash, above its place in code points."""

    def over(h: Column) -> Column:
        n = F.greatest(F.size(h) - (WIDTH - 1), F.lit(0))
        edge = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(WIDTH), n), lambda a, b: F.least(a, b))

        def select(least: Column, i: Column) -> Column:
            closed = least <= h.getItem(i + 1)  # mostly the first comparisons decide
            for j in range(2, WIDTH - 1):
                closed = closed & (least <= h.getItem(i + j))
            name = F.xxhash64(h.getItem(i), h.getItem(i + (WIDTH - 1)))  # first and last s-mer overlap, so they name the k-mer
            return F.when(closed, name.bitwiseAND(F.lit(_HASH)) * F.lit(_PLACE) + i)

        return F.array_compact(F.transform(edge, select))

    return let(s_mers(text), over)


def listed(found: Column, text: Column) -> Column:
    """The fingerprint as numbers: for each anchor its hash and, in the last byte, the distance to the next one."""
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))))

    def entries(x: Column) -> Column:
        following = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
        gap = lambda a, b: F.least(F.coalesce(b % _PLACE - a % _PLACE, F.lit(FAR)), F.lit(FAR))
        return F.zip_with(x, following, lambda a, b: F.shiftright(a, 38) * (FAR + 1) + gap(a, b))  # the last one is followed by null

    return let(found, lambda x: F.when(F.size(x) > 0, entries(x)).otherwise(whole))


def as_text(numbers: Column) -> Column:
    """Eight hex digits a number."""
    return F.array_join(F.transform(numbers, lambda x: F.substring(F.lower(F.hex(x + (1 << 32))), 2, 8)), "")


def places(numbers: Column) -> Column:
    """The set by which texts are matched: each anchor with its distance to the next one and that one's hash."""

    def pairs(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: a * (_HASH + 1) + F.shiftright(b, 8)))

    return let(numbers, lambda x: F.when(F.size(x) > 1, pairs(x)).otherwise(x))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of places."""
    share = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row's text."""
    d = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text"))
    return d.select("doc_id", as_text(listed(anchors(F.col("text")), F.col("text"))).alias("fingerprint"))


def _in_buckets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, tie, text, bucket, extra): rows by buckets of ids, and extra copies of each bucket's first row, after the last of the one above it."""
    d = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text"))
    d = d.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 62))), "tie": F.shiftrightunsigned(F.xxhash64("text"), 12)})
    n = PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(d.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], F.lit(20 * n)).alias("c")).first().c or [])
    own = bucket_of(F.col("key"), cuts)
    shared = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}  # ids that fill buckets of their own
    if shared:
        spread = F.element_at(F.create_map(*[F.lit(x) for c, m in shared.items() for x in (c, m)]), F.col("key"))
        own = own + F.coalesce(F.floor(F.col("tie") / float(1 << 52) * (spread + 1)), F.lit(0))
    d = d.withColumn("own", own.cast("int"))
    firsts = {r.own: r["first"] for r in d.groupBy("own").agg(F.max(F.struct("key", "tie")).alias("first")).collect()}  # at most n rows
    filled = sorted(firsts)
    size = filled[-1] + 1 if filled else 0
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    pick = lambda numbers: F.element_at(longs(numbers), F.col("own") + 1)
    bucket = F.struct(F.col("own").cast("long").alias("bucket"), F.lit(0).alias("extra"))
    if not size:
        return d.select("doc_id", "key", "tie", "text", bucket.bucket.alias("bucket"), bucket.extra.alias("extra"))
    copy = F.struct(pick([above.get(b, 0) for b in range(size)]).alias("bucket"), F.lit(1).alias("extra"))
    is_first = (F.col("key") == pick([firsts[b].key if b in firsts else 0 for b in range(size)])) & (F.col("tie") == pick([firsts[b].tie if b in firsts else 0 for b in range(size)]))
    return d.withColumn("at", F.explode(F.when(is_first, F.array(bucket, copy)).otherwise(F.array(bucket)))).select("doc_id", "key", "tie", "text", "at.bucket", "at.extra")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third replaced by the start of the next document by descending doc_id.
    """
    order = Window.partitionBy("bucket").orderBy("extra", F.col("key").desc(), F.col("tie").desc(), "text")
    text, n = F.col("text"), F.length("text")
    d = _in_buckets(docs).withColumn("next_text", F.lead("text").over(order))
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("head", F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))")).withColumn("graft", F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    d = d.withColumn("found", anchors(text)).withColumn("numbers", listed(F.col("found"), text)).withColumn("places", places(F.col("numbers")))
    # Anchors of the head stand as they are; those that reach into the graft start in its last K - 1 characters or later.
    reach = F.greatest(F.length("head") - (K - 1), F.lit(0))
    tail = anchors(F.concat(F.expr(f"right(head, {K - 1})"), F.col("graft")))
    changed = let(reach, lambda r: F.concat(F.filter("found", lambda x: x % _PLACE < r), F.transform(tail, lambda x: x + r)))  # so that its length is told once, not for each anchor
    edited = F.concat("head", "graft")
    d = d.withColumn("next_places", F.lead("places").over(order)).filter("extra = 0").withColumn("edited_numbers", listed(changed, edited))
    return d.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), as_text(F.col("numbers")).alias("fingerprint"),
        as_text(F.col("edited_numbers")).alias("edited_fingerprint"), let(places(F.col("edited_numbers")), lambda x: likeness(F.col("places"), x)).alias("near_edited"),
        likeness(F.col("places"), F.col("next_places")).alias("near_next"),
    )
