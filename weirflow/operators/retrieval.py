"""Retrieval over a corpus: whole-slice feed, cosine top-k, lexical top-k, rank fusion, and a registry of arms."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import cosine_similarity

# How many results by default and at most, per branch of a fusion, and the constant of rank fusion.
DEFAULT_K, MOST_K, PER_BRANCH, RRF_K = 5, 10, 20, 60
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "which", "with")


def top_k(k: int | None) -> int:
    """The default for none; a number below one asks for nothing; never more than the most."""
    return DEFAULT_K if k is None else max(0, min(k, MOST_K))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the nearest vectors; the query is a literal, so the plan is one scan with a bounded top-k per task. Vectors of another length or without one never match."""
    usable = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    scored = usable.select(key, cosine_similarity(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score")).filter("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def terms(query: str) -> list[str]:
    """The query's distinct words without stop words, in lower case."""
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return list(dict.fromkeys(w for w in words if w not in STOP_WORDS))


def lexical_top_k(docs: DataFrame, query: str, k: int = PER_BRANCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, matched, hits): documents with any of the query's words; more distinct words first, then more occurrences, then the key. A query without words finds nothing.

    One scan without a shuffle before the top-k: words are counted inside each row.
    """
    wanted = terms(query)
    if not wanted or not k:
        return docs.select(key, F.lit(0).alias("matched"), F.lit(0).alias("hits")).filter("false")
    words = F.array(*[F.lit(w) for w in wanted])
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.array_contains(words, w))
    d = docs.select(key, found.alias("f")).filter("size(f) > 0")
    return d.select(key, F.size(F.array_distinct("f")).alias("matched"), F.size("f").alias("hits")).orderBy(F.col("matched").desc(), F.col("hits").desc(), key).limit(k)


def fuse(branches: list[DataFrame], key: str, k: int) -> DataFrame:
    """(key, score): reciprocal-rank fusion of ranked lists (key, rank from 1); ties go to what was listed first."""
    listed = None
    for i, b in enumerate(branches):
        part = b.select(key, F.col("rank").cast("int").alias("rank"), F.lit(i).alias("branch"))
        listed = part if listed is None else listed.unionByName(part)
    scored = listed.groupBy(key).agg(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"), F.min(F.struct("branch", "rank")).alias("first"))
    return scored.orderBy(F.col("score").desc(), "first").limit(max(0, k)).select(key, "score")


def ranked(found: DataFrame, *order) -> DataFrame:
    """The rows of a short list with their rank from 1; only for lists already cut to a few rows."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def with_documents(chunks: DataFrame, documents: DataFrame, key: str = "filename") -> DataFrame:
    """Chunks with their document's title and source: its address, or else its name. Documents are the small side, which AQE broadcasts where it is."""
    d = documents.select(key, F.col("title"), F.coalesce("source_url", key).alias("source"))
    return chunks.join(d, key)


def rendered(context: DataFrame, by: list[str], order: str = "rank", source: str = "source", text: str = "text") -> DataFrame:
    """Per answer its excerpts as one text, numbered from one in their order and parted by a blank line. Its wording is fixed."""
    excerpts = F.array_sort(F.collect_list(F.struct(order, source, text)))  # at most as many as an answer takes
    lines = F.transform(excerpts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), x[source], F.lit(")\n"), x[text]))
    return context.groupBy(*by).agg(F.concat(F.lit("CONTEXT — excerpts from the water-quality corpus:\n\n"), F.array_join(lines, "\n\n")).alias("context"))


def stub_feed(spark: SparkSession, rows: list[tuple[str, str, str]], k: int | None) -> DataFrame:
    """The first of a list of fixed rows (id, text, source): an arm for tests of what is around it."""
    return spark.createDataFrame(rows[: top_k(k)], "id string, text string, source string")


# What an embedding model is told before a question and before a passage, and how many texts it takes at once.
QUERY_PREFIX, PASSAGE_PREFIX, BATCH = "search_query: ", "search_document: ", 32


def batches(texts: DataFrame, key: str, text: str = "text", prefix: str = PASSAGE_PREFIX, size: int = BATCH) -> DataFrame:
    """(part, batch, place, key, text): prefixed texts in batches of at most ``size``, numbered within their task, so that nothing is shuffled."""
    n = F.monotonically_increasing_id()
    d = texts.select(key, F.concat(F.lit(prefix), F.col(text)).alias(text), n.alias("n"))
    own = F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    return d.select(F.shiftright("n", 33).alias("part"), F.floor(own / size).alias("batch"), (own % size).cast("int").alias("place"), key, text)


def with_vectors(batched: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """The texts of batches with their vectors: ``batched`` (batch, place and more) with embedding and error.

    ``items``: batch, index, embedding, what a model returned, in any order; the vector of a text is the one at its place when
    they are ordered by index. A batch with too few or too many vectors, one of another length or one that is all zero (the first is
    told, in this order) has that error in all its rows and no vectors, since texts could be paired with vectors of others.
    A vector that is null has no length; batches are small, so a task sorts no more than some dozens.
    """
    order = Window.partitionBy("batch").orderBy("index", "embedding")
    got = items.select("batch", "embedding", (F.row_number().over(order) - 1).alias("place"))
    length = F.coalesce(F.size("embedding"), F.lit(0))
    wrong, zero = length != dim, (length == dim) & F.forall("embedding", lambda x: x == 0)
    told = got.groupBy("batch").agg(F.count("*").alias("n_out"), F.min_by(length, F.when(wrong, F.col("place"))).alias("other"), F.min(F.when(zero, F.col("place"))).alias("blank"))
    asked = batched.groupBy("batch").agg(F.count("*").alias("n_in")).join(told, "batch", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    say = lambda *parts: F.concat(*[F.lit(p).cast("string") for p in parts])
    error = F.when(F.col("n_out") != F.col("n_in"), say("Embedding API returned ", F.col("n_out"), " vectors for ", F.col("n_in"), " inputs."))
    error = error.when(F.col("other").isNotNull(), say("returned ", F.col("other"), f" dimensions; the schema expects {dim}.")).when(F.col("blank").isNotNull(), say("returned an all-zero vector for input ", F.col("blank"), "."))
    rows = batched.join(asked.select("batch", error.alias("error")), "batch").join(got, ["batch", "place"], "left")
    return rows.select(*batched.columns, F.when(F.col("error").isNull(), F.col("embedding")).alias("embedding"), "error")


def slice_feed(corpus: DataFrame, query: str) -> DataFrame:
    """All documents of the slice in a stable order, however many are asked for; nothing for a blank query."""
    d = corpus.filter("in_slice").select("filename", "title", "text")
    return (d if query.strip() else d.filter("false")).orderBy("filename")


class Arm(Protocol):
    """A way to find context for a question."""

    name: str

    def context(self, spark: SparkSession, query: str, k: int | None) -> DataFrame: ...


class Registry:
    """Retrieval arms by name. A name is taken once; overriding the default is for debugging only."""

    def __init__(self, default: str, debug: bool = False) -> None:
        self.default, self.debug, self._arms = default, debug, {}

    def register(self, arm: Arm) -> None:
        if arm.name in self._arms:
            raise ValueError(f"{arm.name} is registered already")
        self._arms[arm.name] = arm

    def names(self) -> list[str]:
        return sorted(self._arms)

    def resolve(self, asked: str | None = None) -> Arm:
        name = asked if asked and self.debug else self.default
        if name not in self._arms:
            raise KeyError(f"no retrieval arm {name!r}: one of {', '.join(self.names())}")
        return self._arms[name]
