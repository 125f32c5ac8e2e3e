"""Container documents: piece by piece in, in parts out."""

import gzip
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.sources import documents, files


def records_of(text, chunk, packed=False, monkey=None):
    monkey.setattr(documents, "CHUNK", chunk)
    data = text.encode() if isinstance(text, str) else text
    return list(documents.json_records(io.BytesIO(gzip.compress(data) if packed else data), packed))


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
@pytest.mark.parametrize("packed", [False, True])
def test_json_in_chunks(monkeypatch, chunk, packed):
    rows = [{"a": 12345, "b": "ü \\" "], {"}, {"a": -1.5e3, "c": [1, {"d": None}]}, {"x": "日本" * 20}]
    read = lambda value, **k: records_of(json.dumps(value, **k), chunk, packed, monkeypatch)
    for text in ({}, {"indent": 3}, {"ensure_ascii": False}):
        assert read(rows, **text) == rows
        assert read({"version": 2, "records": rows, "after": 1}, **text) == rows
    assert read([]) == [] and read({"data": []}) == []
    assert read({"train": rows[:1], "test": rows[1:2]}) == [rows[0] | {"split": "train"}, rows[1] | {"split": "test"}]
    assert read({"text": ["x", "y"], "label": [1, 2]}) == [{"text": "x", "label": 1}, {"text": "y", "label": 2}]
    assert read({"text": "one", "n": 1}) == [{"text": "one", "n": 1}]
    for bad in ("3", "[1]", '[{"a": 1}', '{"a": 1', '[{"a": 1} oops]'):
        with pytest.raises(ValueError):
            records_of(bad, chunk, packed, monkeypatch)


def test_batches_of_a_large_arrow_file_are_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.arrow")
    schema = pa.schema([("n", pa.int64()), ("text", pa.string())])
    with pa.ipc.new_file(path, schema) as out:
        for k in range(20):
            out.write_batch(pa.record_batch([pa.array(range(100 * k, 100 * k + 100)), pa.array(["t" * 50] * 100)], schema=schema))
    monkeypatch.setattr(documents, "SHARE", 20_000)
    pieces = documents._Reader({"path": path, "kind": "arrow"}).partitions()
    assert len(pieces) >= 5 and pieces[0].first == 0 and pieces[-1].last == 20 and all(a.last == b.first for a, b in zip(pieces, pieces[1:]))
    got = [json.loads(x)["n"] for p in pieces for b in documents._Reader({"path": path, "kind": "arrow"}).read(p) for x in b.column(0).to_pylist()]
    assert got == list(range(2000))
    assert [r.n for r in files.read_dataset(spark, path, number="_o").orderBy("_o").collect()] == list(range(2000))
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), schema) as out:
        out.write_batch(pa.record_batch([pa.array([1, 2]), pa.array(["a", "b"])], schema=schema))
    assert [(r.n, r.text) for r in files.read_dataset(spark, str(tmp_path / "s.arrow"), number="o").orderBy("o").collect()] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("name", ["a.json", "a.json.gz", "a.yaml", "a.yaml.gz", "a.arrow"])
def test_parts_are_joined_in_order(spark, tmp_path, name):
    """Many tasks, some without rows; the order of partitions is the document's."""
    path = str(tmp_path / name)
    df = spark.range(0, 1000, 1, 7).select("id", F.concat(F.lit("row "), "id").alias("text")).where("id % 500 < 300 or id > 990")
    files.write_dataset(df, path)
    want = [r.id for r in df.collect()]
    assert [r.id for r in files.read_dataset(spark, path, number="o").orderBy("o").collect()] == want
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == [name]
    if "json" in name:
        data = (tmp_path / name).read_bytes()
        assert [x["id"] for x in json.loads(gzip.decompress(data) if name.endswith("gz") else data)] == want
    files.write_dataset(df.limit(0), path)
    assert files.read_dataset(spark, path).count() == 0


def test_a_failed_writer_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.write_dataset(spark.range(3), path)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.write_dataset(bad, path)
    assert files.read_dataset(spark, path).count() == 3


def test_relative_paths(spark, tmp_path, monkeypatch):
    """A path is Spark's to resolve, wherever workers run."""
    monkeypatch.setattr(documents, "known", lambda path: path.startswith("file:/") or pytest.fail(path))
    where = documents.qualified(spark, "some/x.json")
    assert where.startswith("file:/") and where.endswith("/some/x.json") and documents.opened(where)[1].startswith("/")
    assert documents.qualified(spark, f"{tmp_path}/y") == f"file:{tmp_path}/y" and documents.opened(f"file://{tmp_path}/y")[1] == f"{tmp_path}/y"


def test_paths_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    monkeypatch.setattr(documents, "known", lambda path: False)
    assert [r.a for r in files.read_dataset(spark, str(tmp_path / "x.json"), number="o").orderBy("o").collect()] == [1, 2]
    with pytest.raises(ValueError, match="workers can open"):
        files.write_dataset(spark.range(1), str(tmp_path / "y.json"))
