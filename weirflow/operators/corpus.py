"""Corpus preparation: chunks with overlap, quality, the document artifact, loads that repeat safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import chunk_id, good_chunk, safe_id, token_estimate
from weirflow.functions.text import chunk_text

# Limits of a stored document and of a load.
MAX_DOCUMENT_BYTES, MAX_CHUNKS = 943_718, 500


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk, chunk_id): overlapping pieces of each text."""
    d = docs.select(key, F.posexplode(chunk_text(F.col(text))).alias("chunk_index", "chunk"))
    return d.withColumn("chunk_id", chunk_id(F.col(key).cast("string"), F.col("chunk_index")))


def ingested(docs: DataFrame, structured: bool = False) -> DataFrame:
    """filename, text and the chunks that pass for quality; documents without one are dropped. Structured texts skip the share of letters."""
    d = docs.select("filename", "title", "text", chunk_text("text").alias("made"))
    d = d.withColumn("chunks", F.filter("made", lambda c: good_chunk(c, not structured)))
    return d.select("filename", F.coalesce("title", "filename").alias("title"), "text", F.length("text").alias("chars"), "chunks", F.size("made").alias("chunks_before_filter")).filter("size(chunks) > 0")


def summary(corpus: DataFrame) -> DataFrame:
    """One row: documents, characters, chunks if the corpus has them, characters in the slice, and their estimated tokens."""
    s = F.coalesce(F.sum(F.when(F.col("in_slice"), F.col("chars"))), F.lit(0))
    chunks = [F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks")] if "chunks" in corpus.columns else []
    return corpus.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), *chunks, s.alias("slice_chars"), token_estimate(s).alias("slice_tokens"))


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "filename") -> DataFrame:
    """What is not loaded yet."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def insert_new(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append so that each combination of keys is there once: repeats and what exists are left out."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def document_bytes(docs: DataFrame) -> DataFrame:
    """The documents with the size of their stored form."""
    return docs.select("*", F.octet_length(F.to_json(F.struct(*docs.columns))).alias("bytes"))


def oversized(docs: DataFrame) -> DataFrame:
    """Documents whose JSON exceeds the greatest size of a stored one; a load with any is refused."""
    return document_bytes(docs).filter(F.col("bytes") > MAX_DOCUMENT_BYTES)


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "filename") -> DataFrame:
    """The stored documents with the incoming ones in place of, or beside, those of the same identifier (made from the key)."""
    own = incoming.withColumn("id", safe_id(F.col(key)))
    kept = stored.withColumn("id", safe_id(F.col(key))).join(own.select("id"), "id", "left_anti")
    return kept.unionByName(own, allowMissingColumns=True).drop("id")


def loadable(incoming: DataFrame, existing: DataFrame | None, key: str = "filename") -> DataFrame:
    """Documents whose chunks are to be loaded: those not there yet, with one chunk at least and no more than a load takes."""
    new = incoming if existing is None else new_only(incoming, existing, key)
    return new.filter(F.size("chunks").between(1, MAX_CHUNKS))


def index_lists(n_chunks):
    """Number of lists of a coarse vector index: the root of the chunks, from 10 to 100."""
    return F.greatest(F.least(F.round(F.sqrt(n_chunks)), F.lit(100)), F.lit(10)).cast("int")
