"""Tables of files that change as a whole or not at all.

Rows are dealt into parts by a hash of their key. A change writes the parts it touches into a new folder and then one
small manifest, which names the folders of every part; the newest manifest is the table. A writer that dies before its
manifest changes nothing and leaves a folder that nobody reads; of two writers that start from one state the second
finds its manifest taken and fails. Readers keep the state they began with.

    path/_versions/manifests/000000000007.json    path/_versions/data/<id>/part=3/...
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a new table.
PARTS = 16


class Conflict(RuntimeError):
    """Another writer changed the table since it was read."""


class VersionedTable:
    """A table in a folder. ``key`` makes of a row's columns what its part goes by; equal keys share a part."""

    def __init__(self, spark: SparkSession, path: str, key: Column, parts: int = PARTS) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self._root = f"{self.path}/_versions"

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict]:
        folder, files = self._place(f"{self._root}/manifests"), self._files()
        numbers = [int(s.getPath().getName()[:-5]) for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")] if files.exists(folder) else []
        if not numbers:
            return 0, {}
        stream = files.open(self._place(f"{self._root}/manifests/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._newest()[0] > 0

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame | None:
        folders = [f for p, fs in manifest.get("parts", {}).items() if parts is None or int(p) in parts for f in fs]
        if "schema" not in manifest:
            return None
        schema = manifest["schema"]
        return self.spark.read.schema(schema).parquet(*[f"{self._root}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as its newest manifest has it."""
        found = self._read(self._newest()[1])
        if found is None:
            raise FileNotFoundError(self.path)
        return found

    def _dealt(self, rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int"))

    def change(self, incoming: DataFrame, merge, base: DataFrame | None = None) -> None:
        """Put ``merge(rows of the touched parts, incoming)`` in the place of the parts that incoming rows touch. Other parts are neither read nor written. ``base`` is what a table without a manifest begins with."""
        number, manifest = self._newest()
        parts = manifest.get("count", self.parts)
        new = self._dealt(incoming, parts)
        first = number == 0 and base is not None
        touched = list(range(parts)) if first else sorted(r.part for r in new.select("part").distinct().collect())  # at most the parts
        old = base if first else self._read(manifest, touched)
        self._commit(number, manifest, incoming if old is None else merge(old, incoming), touched, parts, replace=True)

    def append(self, incoming: DataFrame) -> None:
        """Add rows; all of them are there once the manifest is."""
        number, manifest = self._newest()
        self._commit(number, manifest, incoming, [], manifest.get("count", self.parts), replace=False)

    def _commit(self, number: int, manifest: dict, rows: DataFrame, touched: list[int], parts: int, replace: bool) -> None:
        folder = uuid.uuid4().hex
        self._write(self._dealt(rows, parts), f"{self._root}/data/{folder}")
        files, there = self._files(), self._place(f"{self._root}/data/{folder}")
        written = [s.getPath().getName() for s in files.listStatus(there) if s.getPath().getName().startswith("part=")] if files.exists(there) else []
        lists = {p: ([] if replace and int(p) in touched else fs) for p, fs in manifest.get("parts", {}).items()}
        for name in written:
            lists[name[5:]] = [*lists.get(name[5:], []), f"{folder}/{name}"]
        schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._publish(number + 1, {"count": parts, "schema": schema, "parts": lists})

    def _write(self, dealt: DataFrame, path: str) -> None:
        dealt.repartition("part").write.partitionBy("part").parquet(path)

    def _publish(self, number: int, manifest: dict) -> None:
        """Write the manifest beside its place and move it there, which fails if there is one."""
        jvm, files = self.spark._jvm, self._files()
        side, place = self._place(f"{self._root}/manifests/.{uuid.uuid4().hex}"), self._place(f"{self._root}/manifests/{number:012d}.json")
        stream = files.create(side, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(side), files.makeQualified(place), options)
        except Exception as e:
            files.delete(side, False)
            raise Conflict(f"version {number} of {self.path} is taken") from e
