"""A training corpus from raw documents: toxic ones go, copies and near copies go, sources are mixed to target weights, and what is left is packed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Labels are read from ``sf_dir``. Texts are judged where they are read;
decisions reach the documents as ids, broadcast only where they were counted and are few, so no stage
shuffles whole texts below that size.

Defined results of every stage: an empty table gives no rows; a null text counts as empty, is judged like one, and
empty texts are copies of each other; a null doc_id is an id like any other that comes after all the rest; rows that
repeat are rows of their own, of which the dedup stages leave one; texts may be of any length; further columns of the
input, whatever their names, come out as they went in, but for the last stage, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.chunk_dedup import drop_copies
from weirflow.llm.common import materialise, release
from weirflow.llm.mixing import mixed
from weirflow.llm.packing import pack
from weirflow.llm.parity_join import Similarity, drop_similar
from weirflow.llm.toxicity import drop_toxic


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. A text without evidence, an empty one among them, stays; without labels all stay."""
    return drop_toxic(docs, _labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for runs of white space) the one with the smallest doc_id stays; of rows that repeat it the least by all columns."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest doc_id stays.

    Texts without words have no shingles and stay. Rows that repeat the doc_id that stays, and have another text of the same group, go.
    """
    return drop_similar(docs, Similarity(width=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their rates say, so that domains approach their target weights; none is lost. Without labels none is repeated."""
    return mixed(docs, _labels(spark, sf_dir))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 4096. An empty text is its end token; of repeated rows each is packed."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trained models and token ids are no matter of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
