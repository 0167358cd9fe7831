"""Readers and writers of the domain's files. Schemas are given, never inferred; nothing is read on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.scalars import lenient_double, safe_id
from weirflow.operators.corpus import MAX_CHUNKS, loadable, oversized, upserted
from weirflow.operators.evaluation import fixture_errors
from weirflow.sources.versions import VersionedTable

FIXTURE = """filename string, id string, class string, expected_to_favor string, answerable_from array<string>, requires array<string>, notes string,
    turns array<struct<role: string, content: string, rubric: struct<must_contain: array<string>, must_not: array<string>, cite: array<string>, notes: string>>>"""
TRANSCRIPT = """fixtureId string, fixtureClass string, arm string, pass string,
    turns array<struct<index: int, question: string, answer: string, context: array<struct<id: string, text: string, source: string, score: double>>,
        usage: struct<promptTokens: long, completionTokens: long, totalTokens: long, cachedPromptTokens: long>, timing: struct<ttftMs: double, wallMs: double>, error: string>>"""


class SourceError(Exception):
    """A source that cannot be read; ``code`` is one of unauthorised, timeout, unavailable and rejected."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def http_error(status: int | None, timed_out: bool = False) -> SourceError:
    """The error for an HTTP answer, or for none."""
    if timed_out:
        return SourceError("timeout", "the source did not answer in time")
    if status == 401:
        return SourceError("unauthorised", "the credentials are not accepted")
    if status is None or status >= 500:
        return SourceError("unavailable", f"the source failed ({status})")
    return SourceError("rejected", f"the source rejected the request ({status})")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.{md,txt}", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(filename, text) of whole files by name, those named in ``exclude`` left out."""
    d = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    d = d.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("filename"), F.col("value").alias("text"))
    return (d.filter(~F.col("filename").isin(*exclude)) if exclude else d).orderBy("filename")


def scanned(chars, pages):
    """Whether extracted text is so little that the pages must be images."""
    return (F.coalesce(chars, F.lit(0)) / F.greatest(pages, F.lit(1))) < 50


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.schema(FIXTURE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return d.withColumn("filename", F.element_at(F.split("_metadata.file_path", "/"), -1))


def valid_fixtures(spark: SparkSession, folder: str, known: list[str], in_slice: list[str], classes: list[str]) -> DataFrame:
    """The fixtures of a folder by name. All are checked, then all errors are raised at once."""
    d = fixtures(spark, folder)
    wrong = fixture_errors(d, known, in_slice, classes).orderBy("id", "error").limit(201).collect()
    if wrong:
        raise ValueError("\n".join(f"{r.id}: {r.error}" for r in wrong))
    return d.orderBy("filename")


def transcripts_of(asked: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each transcript asked for (pass, arm, fixtureId): its turns, null where there is none."""
    return asked.join(found.select("pass", "arm", "fixtureId", "turns"), ["pass", "arm", "fixtureId"], "left")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts written by `write_transcripts`, their partitions pruned by pass and arm."""
    return spark.read.schema(TRANSCRIPT).json(folder)


def write_transcripts(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("pass", "arm").json(folder)


def sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """(device, measured_at, and five metrics) from a headed CSV whose dates read HH:mm MM/dd/yyyy; NA, blanks and unreadable cells are null."""
    names = ("dissolved_oxygen", "orp", "ph", "conductivity", "temperature")
    d = spark.read.schema("device string, date string, " + ", ".join(f"{n} string" for n in names)).csv(path, header=True, enforceSchema=True, nullValue="NA")
    return d.select("device", F.try_to_timestamp(F.trim("date"), F.lit("HH:mm MM/dd/yyyy")).alias("measured_at"), *[lenient_double(F.col(n)).alias(n) for n in names])


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def upsert_corpus(df: DataFrame, path: str) -> None:
    """Put documents into the stored corpus, in place of those of the same identifier; the others stay. Nothing is written if one is too large.

    The corpus is a plain folder that any reader can open: the new state is written beside the old one and then takes its place, in two
    steps. A corpus that must survive a writer's death between them is a versioned one (`put_documents`).
    """
    if not oversized(df).isEmpty():
        raise ValueError("a document exceeds the greatest stored size; nothing was written")
    spark = df.sparkSession
    if not _there(spark, path):
        write_corpus(df, path)
        return
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    upserted(spark.read.parquet(path), df).write.parquet(new)
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.rename(place(path), place(old))
    files.rename(place(new), place(path))
    files.delete(place(old), True)


def load_chunks(incoming: DataFrame, path: str) -> DataFrame:
    """Append the chunks (filename, title, chunk_index, text) of documents that are not there yet; those without a chunk, or with more than a load takes, are skipped and returned."""
    spark = incoming.sparkSession
    existing = spark.read.parquet(path) if _there(spark, path) else None
    chosen = loadable(incoming, existing)
    chosen.select("filename", "title", F.posexplode("chunks").alias("chunk_index", "text")).write.mode("append").parquet(path)
    return incoming.filter(~F.coalesce(F.size("chunks").between(1, MAX_CHUNKS), F.lit(False)))


def _documents(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, safe_id(F.col("filename")))


def _chunks(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, F.col("filename"))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """A versioned corpus, or a plain one that nothing was put into yet."""
    table = _documents(spark, path)
    return table.read() if table.exists() else spark.read.parquet(path)


def put_documents(df: DataFrame, path: str) -> None:
    """Put documents into a versioned corpus, in place of those of the same identifier; the others stay. Nothing is written if one is too large.

    The corpus changes as a whole, when the manifest of its new state is there (`sources.versions`); only parts with a document that
    comes in are written anew. Of a plain corpus in the folder all documents are taken over first.
    """
    if not oversized(df).isEmpty():
        raise ValueError("a document exceeds the greatest stored size; nothing was written")
    spark, table = df.sparkSession, _documents(df.sparkSession, path)
    base = spark.read.parquet(path) if not table.exists() and _there(spark, path) else None
    table.change(df, upserted, base)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _chunks(spark, path).read()


def put_chunks(incoming: DataFrame, path: str) -> DataFrame:
    """`load_chunks` into a versioned table: all chunks of all documents of a load are there at once, or none."""
    table = _chunks(incoming.sparkSession, path)
    chosen = loadable(incoming, table.read() if table.exists() else None)
    table.append(chosen.select("filename", "title", F.posexplode("chunks").alias("chunk_index", "text")))
    return incoming.filter(~F.coalesce(F.size("chunks").between(1, MAX_CHUNKS), F.lit(False)))


def score_sheet(fixtures: DataFrame, labels: list[str]) -> DataFrame:
    """A row to be filled in for each fixture, turn and label, in that order."""
    turns = fixtures.select("id", F.posexplode("turns").alias("turn", "t"))
    blank = F.lit(None).cast("string")
    rows = turns.select("id", "turn", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), blank.alias("score"), blank.alias("notes"))
    return rows.orderBy("id", "turn", "label")


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_prompts(df: DataFrame, path: str) -> None:
    """Starter prompts as JSON, a line each."""
    df.write.mode("overwrite").json(path)


def slice_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The slice from a corpus artifact or a store of documents; an unknown kind is an error, never a fallback."""
    if kind not in ("artifact", "store"):
        raise ValueError(f"unknown corpus source {kind!r}")
    d = spark.read.parquet(path).filter("in_slice").select("filename", "title", "source_url", "text")
    return d.orderBy("filename") if kind == "store" else d
