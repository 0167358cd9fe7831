"""Tables that change as a whole: a writer that dies at any step leaves the old state."""

import os

import pytest
from pyspark.sql import functions as F

from weirflow.operators.corpus import upserted
from weirflow.sources import files
from weirflow.sources.versions import Conflict, VersionedTable


def docs(spark, rows):
    return spark.createDataFrame(rows, "filename string, text string")


def state(df):
    return sorted((r.filename, r.text) for r in df.collect())


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "corpus")
    files.write_corpus(docs(spark, [("a b.md", "1"), ("c.md", "1"), ("d.md", "1")]), path)
    assert state(files.stored_documents(spark, path)) == [("a b.md", "1"), ("c.md", "1"), ("d.md", "1")]
    files.put_documents(docs(spark, [("a_b.md", "2"), ("e.md", "2")]), path)
    assert state(files.stored_documents(spark, path)) == [("a_b.md", "2"), ("c.md", "1"), ("d.md", "1"), ("e.md", "2")]
    before = files.stored_documents(spark, path)
    files.put_documents(docs(spark, [("c.md", "3")]), path)
    assert state(files.stored_documents(spark, path)) == [("a_b.md", "2"), ("c.md", "3"), ("d.md", "1"), ("e.md", "2")]
    assert state(before) == [("a_b.md", "2"), ("c.md", "1"), ("d.md", "1"), ("e.md", "2")]  # a reader keeps its state
    newest = sorted(os.listdir(f"{path}/_versions/data"), key=lambda d: os.path.getmtime(f"{path}/_versions/data/{d}"))[-1]
    assert len([p for p in os.listdir(f"{path}/_versions/data/{newest}") if p.startswith("part=")]) == 1  # one part of sixteen is written anew


@pytest.mark.parametrize("step", ["_write", "_publish"])
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_dies(spark, tmp_path, monkeypatch, step, after):
    """Killed before or after a step: the state is the old one, or the new one once the manifest is there, never anything else; and the next writer goes on."""
    path, whole = str(tmp_path / "corpus"), getattr(VersionedTable, step)
    files.put_documents(docs(spark, [("a", "1"), ("b", "1")]), path)

    def dies(self, *args):
        if after:
            whole(self, *args)
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, step, dies)
    with pytest.raises(KeyboardInterrupt):
        files.put_documents(docs(spark, [("b", "2"), ("c", "2")]), path)
    monkeypatch.setattr(VersionedTable, step, whole)
    done = step == "_publish" and after
    assert state(files.stored_documents(spark, path)) == ([("a", "1"), ("b", "2"), ("c", "2")] if done else [("a", "1"), ("b", "1")])
    files.put_documents(docs(spark, [("d", "3")]), path)
    assert ("d", "3") in state(files.stored_documents(spark, path)) and len(state(files.stored_documents(spark, path))) == (4 if done else 3)


def test_two_writers(spark, tmp_path):
    """The second of two that began from one state fails, and changes nothing."""
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, F.col("filename"), 4)
    table.append(docs(spark, [("a", "1")]))

    def meanwhile(old, new):
        VersionedTable(spark, path, F.col("filename")).append(docs(spark, [("z", "9")]))
        return upserted(old, new)

    with pytest.raises(Conflict):
        table.change(docs(spark, [("a", "2")]), meanwhile)
    assert state(table.read()) == [("a", "1"), ("z", "9")]


def test_chunks(spark, tmp_path):
    """A load is there as a whole; documents that are there stay as they are; empty loads and missing tables."""
    path = str(tmp_path / "chunks")
    with pytest.raises(FileNotFoundError):
        files.stored_chunks(spark, path)
    load = lambda rows: files.put_chunks(spark.createDataFrame(rows, "filename string, title string, chunks array<string>"), path).count()
    assert load([("a", "A", ["x", "y"]), ("b", "B", [])]) == 1
    assert load([("a", "A", ["other"]), ("c", "C", ["z"])]) == 0 and load([]) == 0
    assert sorted((r.filename, r.chunk_index, r.text) for r in files.stored_chunks(spark, path).collect()) == [("a", 0, "x"), ("a", 1, "y"), ("c", 0, "z")]
