"""Container documents (JSON, YAML, Arrow) read piece by piece and written by tasks: no task holds a file, and no data passes the driver.

Workers open files themselves, so a file system that pyarrow knows is needed (local, s3, gs, abfs, hdfs with libhdfs).
"""

from __future__ import annotations

import codecs
import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of an Arrow file that one task reads, about; characters of a JSON document that are looked at together.
SHARE, CHUNK = 128 << 20, 1 << 20
#: Keys under which a document may wrap its records, first come first.
WRAPPERS = ("data", "records", "items")
#: The column of the split that a record of a split container came from.
SPLIT = "split"
SCHEMA = "value string, _gm_file string, _gm_block long, _gm_at long"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark resolves it: workers know neither the default file system nor the driver's folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def known(path: str) -> bool:
    """Whether workers can open a qualified path themselves."""
    try:
        opened(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class _Text:
    """A text stream with a buffer that grows only as far as one value needs."""

    def __init__(self, source, packed: bool):
        self.source = gzip.GzipFile(fileobj=source) if packed else source
        self.decode, self.text, self.at, self.ended = codecs.getincrementaldecoder("utf-8-sig")(), "", 0, False

    def more(self, size: int = CHUNK) -> bool:
        """Read on; False at the end."""
        if self.ended:
            return False
        data = self.source.read(size)
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decode.decode(data, self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no white space, '' at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise ValueError(f"a JSON document has {self.peek()!r} where {c!r} is due")
        self.at += 1

    def value(self):
        """The next JSON value; it is whole once something follows it or the text has ended."""
        size = CHUNK
        self.peek()
        while True:
            try:
                found, end = json.JSONDecoder().raw_decode(self.text, self.at)
                if end < len(self.text) or not self.more():
                    self.at = end
                    return found
            except ValueError:
                if not self.more(size):
                    raise
                size *= 2


def _elements(text: _Text) -> Iterator:
    """The elements of an array, one at a time."""
    text.take("[")
    while text.peek() != "]":
        yield text.value()
        if text.peek() == ",":
            text.at += 1
    text.take("]")


def _checked(row, more: dict | None = None) -> dict:
    if not isinstance(row, dict):
        raise ValueError("every record must be an object")
    return row if more is None else row | more


def json_records(source, packed: bool = False) -> Iterator[dict]:
    """The records in a JSON document: a list, a wrapper, splits, columns or one object.

    A list is read element by element, alone or under a wrapper's key (the first such key of a document); any other object,
    as one of splits or columns, is held whole. Beside a wrapper's key nothing else of an object counts.
    """
    text = _Text(source, packed)
    first = text.peek()
    if first == "[":
        yield from map(_checked, _elements(text))
        return
    if first != "{":
        raise ValueError("a dataset document must be a list or an object")
    text.take("{")
    held: dict = {}
    while text.peek() == '"':
        key = text.value()
        text.take(":")
        if text.peek() == "[" and key in WRAPPERS:
            yield from map(_checked, _elements(text))
            return
        held[key] = text.value()
        if text.peek() == ",":
            text.at += 1
    text.take("}")
    yield from container_rows(held)


def container_rows(data) -> list[dict]:
    """The records in a document that is held whole: a list, a wrapper, splits, columns or one object."""
    if isinstance(data, list):
        rows = data
    elif not isinstance(data, dict):
        raise ValueError("a dataset document must be a list or an object")
    elif wrapped := next((data[k] for k in WRAPPERS if isinstance(data.get(k), list)), None):
        rows = wrapped
    elif data and all(isinstance(v, list) for v in data.values()):
        if all(isinstance(x, dict) for v in data.values() for x in v):
            rows = [x | {SPLIT: k} for k, v in data.items() for x in v]
        else:
            rows = [dict(zip(data, vs)) for vs in zip(*data.values())]
    else:
        rows = [data]
    return [_checked(x) for x in rows]


def yaml_records(source, packed: bool = False) -> Iterator[dict]:
    """The records in a YAML document, which is held whole: the parser keeps anchors to its end."""
    import yaml

    yield from container_rows(yaml.safe_load((gzip.GzipFile(fileobj=source) if packed else source).read()))


def arrow_records(source, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """The rows of some record batches of an Arrow file, or of all of a stream, one batch at a time."""
    try:
        found = pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        source.seek(0)
        batches = iter(pa.ipc.open_stream(source))
    else:
        batches = (found.get_batch(k) for k in range(first, found.num_record_batches if last is None else last))
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            yield from b.slice(k, 1000).to_pylist()


def _measured(batches, root: str, most_total: int, most_record: int) -> Iterator[pa.RecordBatch]:
    """size, record: the bytes that each packed file has unpacked and those of its longest line, counted a piece at a time up to the limits."""
    fs, _ = opened(root)
    for b in batches:
        for path in b.column(0).to_pylist():
            size = line = record = 0
            with fs.open_input_file(opened(path)[1]) as source:
                unpacked = gzip.GzipFile(fileobj=source)
                while size <= most_total and record <= most_record and (data := unpacked.read(CHUNK)):
                    size += len(data)
                    ends = data.split(b"\n")
                    line += len(ends[0])
                    record = max(record, line, *(len(x) for x in ends[1:]))
                    line = len(ends[-1]) if len(ends) > 1 else line
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([record], pa.int64())], names=["size", "record"])


def unpacked_sizes(spark: SparkSession, paths: list[str], most_total: int, most_record: int) -> tuple[int, int]:
    """Bytes of gzip files when unpacked, and those of their longest line; a file that is above a limit is read no further than it."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 200))
    one = files.mapInArrow(partial(_measured, root=paths[0], most_total=most_total, most_record=most_record), "size long, record long").agg(F.sum("size").alias("size"), F.max("record").alias("record")).first()
    return one["size"] or 0, one["record"] or 0


@dataclass
class Piece(InputPartition):
    """A file, or the record batches first to last of it; split is its subfolder's name in a dataset of splits."""

    path: str
    first: int = 0
    last: int | None = None
    split: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]

    def partitions(self) -> list[Piece]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not any(x[0] in "._" for x in posixpath.relpath(f.path, root).split("/"))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if self.kind == "dataset" and not f.path.endswith(".arrow"):
                continue
            split = f.path.split("/")[-2] if self.kind == "dataset" and "/dataset_dict/" in f.path else None
            cuts = self._batches(fs, f) if self.kind in ("arrow", "dataset") and f.size > SHARE else [(0, None)]
            out += [Piece(f.path, a, b, split) for a, b in cuts]
        return out

    def _batches(self, fs, f) -> list[tuple[int, int | None]]:
        """Ranges of a large file's record batches; a stream has no table of them and is one range."""
        with fs.open_input_file(f.path) as source:
            try:
                n = pa.ipc.open_file(source).num_record_batches
            except pa.ArrowInvalid:
                return [(0, None)]
        each = max(1, round(n * SHARE / f.size))
        return [(k, min(n, k + each)) for k in range(0, n, each)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        packed = piece.path.lower().endswith(".gz")
        with fs.open_input_file(piece.path) as source:
            rows = arrow_records(source, piece.first, piece.last) if self.kind in ("arrow", "dataset") else json_records(source, packed) if self.kind == "json" else yaml_records(source, packed)
            held, at = [], 0
            for row in rows:
                held.append(json.dumps(row if piece.split is None else row | {SPLIT: piece.split}, ensure_ascii=False, default=str))
                if len(held) == 1000:
                    yield self._batch(held, piece, at)
                    held, at = [], at + 1000
            if held:
                yield self._batch(held, piece, at)

    def _batch(self, lines: list[str], piece: Piece, at: int) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([piece.path] * n, pa.string()), pa.array([piece.first] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=["value", "_gm_file", "_gm_block", "_gm_at"])


class Documents(DataSource):
    """spark.read.format("gristmill_documents").option("path", ...).option("kind", "json" | "yaml" | "arrow" | "dataset")."""

    @classmethod
    def name(cls) -> str:
        return "gristmill_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """value (a JSON line a record), and its place: file, first record batch of the piece, row in the piece."""
    spark.dataSource.register(Documents)
    return spark.read.format("gristmill_documents").option("path", qualified(spark, path)).option("kind", kind).load()


def _part_writer(batches, folder: str, kind: str, packed: bool) -> Iterator[pa.RecordBatch]:
    """Writes a task's rows as a part of a document; gives the part's number and path."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    number = TaskContext.get().partitionId()
    path, out, writer, rows = posixpath.join(root, f"{number:06}-{uuid.uuid4().hex}"), None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            out = fs.open_output_stream(path)
            out = gzip.GzipFile(fileobj=out, mode="wb") if packed else out
        if kind == "arrow":
            writer = writer or pa.ipc.new_stream(out, b.schema)
            writer.write_batch(b)
            continue
        lines = b.column(0).to_pylist()
        if kind == "yaml":
            import yaml

            out.write(yaml.safe_dump([json.loads(x) for x in lines], allow_unicode=True, sort_keys=False).encode())
        else:
            out.write(((",\n" if rows else "") + ",\n".join(lines)).encode())
        rows += len(lines)
    if out is not None:
        if writer:
            writer.close()
        sink = out.fileobj if packed else out
        if packed:
            out.close()
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path])], names=["number", "path"])


def _joiner(batches, target: str, kind: str, packed: bool, schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    """Copies parts into one document, a piece at a time; gzip members of parts follow each other as they are."""
    paths = [p for b in batches for p in b.column(0).to_pylist()]
    fs, path = opened(target)
    wrap = (lambda text: gzip.compress(text)) if packed else bytes
    with fs.open_output_stream(path) as out:
        if kind == "arrow":
            with pa.ipc.new_file(out, schema) as writer:
                for p in paths:
                    with fs.open_input_stream(p) as source:
                        for b in pa.ipc.open_stream(source):
                            writer.write_batch(b.cast(schema) if b.schema != schema else b)
        else:
            out.write(wrap(b"[\n" if kind == "json" else b"" if paths else b"[]\n"))
            for k, p in enumerate(paths):
                if k and kind == "json":
                    out.write(wrap(b",\n"))
                with fs.open_input_stream(p) as source:
                    while data := source.read(4 << 20):
                        out.write(data)
            if kind == "json":
                out.write(wrap(b"\n]\n"))
    yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])


def write_document(rows: DataFrame, temp: str, kind: str, packed: bool) -> None:
    """rows as one document at `temp`, in the order of their partitions: tasks write parts, then one task puts these together.

    The driver gets the parts' names alone. A part of a task that failed or ran twice has a name of its own and isn't taken.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    temp = qualified(spark, temp)
    folder = f"{temp}.parts"
    schema = to_arrow_schema(rows.schema) if kind == "arrow" else None
    lines = rows if kind == "arrow" else rows.select(F.to_json(F.struct(*(f"`{c}`" for c in rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
    parts = lines.mapInArrow(partial(_part_writer, folder=folder, kind=kind, packed=packed), "number int, path string").collect()
    names = spark.createDataFrame([(r["path"],) for r in sorted(parts)], "path string").coalesce(1)
    names.mapInArrow(partial(_joiner, target=temp, kind=kind, packed=packed, schema=schema), "path string").collect()
    fs, root = opened(folder)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        fs.delete_dir(root)
