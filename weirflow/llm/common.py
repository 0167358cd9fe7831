"""What the operators of this subpackage share: durable intermediates, size-checked joins, bounded samples."""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows of a few fixed-width columns.
BROADCAST_ROWS = 1_000_000

_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where it is unset a temporary one, if there is one machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="weirflow-")
    return _LOCAL["dir"]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage so that a lost executor costs no recomputation of earlier passes, fixes values that a
    retry could change (partition numbers), and gives later joins exchanges of their own on both sides,
    which AQE can split when a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weirflow-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*written: DataFrame) -> None:
    """Delete the files of materialised results. Only for those whose successors are all written out: nothing may read them again, not even a retry."""
    for df in written:
        if path := _PATHS.pop(df, None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            folder = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised side has at most ``rows`` rows."""
    return df.count() <= rows


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a narrow, materialised right side: broadcast if its counted size allows, else a shuffle join that AQE may split."""
    return left.join(F.broadcast(right) if small_enough(right) else right, on, how)


def crc_mod(id_column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def unit_hash(*columns: str | Column, seed: int) -> Column:
    """A draw in [0, 1) that depends on the given columns and the seed only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def text_of(docs: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below the key, looked up in two steps of about as many comparisons."""
    each = max(128, math.isqrt(len(bounds)))
    if len(bounds) <= each:
        return F.size(F.filter(longs(bounds), lambda x: x < key))
    parts = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    nested = F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" for x in p) + ")" for p in parts) + ")")
    top = F.size(F.filter(longs([p[-1] for p in parts[:-1]]), lambda x: x < key))
    return let(top, lambda i: i * each + F.size(F.filter(F.element_at(nested, i + 1), lambda x: x < key)))


def longs(numbers: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in numbers]).cast("array<bigint>")


def row_keys(docs: DataFrame, digest: Column) -> dict[str, Column]:
    """Null-safe columns that tell a row by its doc_id and a digest of its text."""
    doc_id = F.col("doc_id").cast("long")
    return {"_wf_null": doc_id.isNull(), "_wf_id": F.coalesce(doc_id, F.lit(0)), "_wf_sha": digest}


def keep_rows(docs: DataFrame, digest: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that ``decided`` (a row for each key of `row_keys`: _wf_kept, and _wf_n rows with this key) lets go.

    Of a key that is kept and there several times the least row by all columns stays; only such rows are grouped. No other
    row is shuffled unless the keys that change something exceed the broadcast bound.
    """
    key = ["_wf_null", "_wf_id", "_wf_sha"]
    rows = docs.select(whole_row(docs), *[c.alias(n) for n, c in row_keys(docs, digest).items()])
    rest = keyed_join(rows, materialise(decided.filter("NOT _wf_kept OR _wf_n > 1").select(*key), "changed"), key, "left_anti").select("_wf_row.*")
    again = materialise(decided.filter("_wf_kept AND _wf_n > 1").select(*key), "again")
    if again.isEmpty():
        return rest
    return rest.unionByName(keyed_join(rows, again, key, "left_semi").groupBy(*key).agg(F.min("_wf_row").alias("_wf_row")).select("_wf_row.*"))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of the input can clash with names of a plan."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_wf_row")
