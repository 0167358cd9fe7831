"""Intermediates that are written once, so that what follows neither repeats them nor carries their plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. Where it is unset a temporary one stands in, on a single machine only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN["path"] = tempfile.mkdtemp(prefix="weirflow-durable-")
    return _OWN["path"]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder. Its files stay until the folder is cleared, since results may be read late."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
