"""Token-id files of independent zstandard frames with a trailing seek table."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, kind, new_path
from .tokens import tokenizer

#: Fixed values of the public zstandard seekable format: a skippable frame with (compressed size, size, checksum) per
#: frame, then frame count, flags (0x80: with checksums) and a closing number.
SKIPPABLE, DOC_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
ENTRY, FOOTER, HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
#: One per document: id, id is null, first token within the file, number of tokens.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u4")])


class FrameWriter:
    """Writes ids as frames of about `frame_tokens` ids; a document lies in one frame unless it is longer than that.

    The file: frames of packed ids, a skippable frame with the (compressed) table of documents, and the seek table with
    the sizes and checksums of all of these. Decoders of plain zstandard read the ids and skip the rest.
    """

    def __init__(self, out, width: int = 2, frame_tokens: int = 65_536, level: int = 3):
        self.out, self.width, self.frame_tokens = out, width, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.documents, self.held, self.n_held, self.total = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_tokens:
            self._frame()
        self.documents.append((doc_id or 0, doc_id is None, self.total, len(ids)))
        self.total += len(ids)
        for at in range(0, len(ids), self.frame_tokens):
            part = ids[at : at + self.frame_tokens]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held >= self.frame_tokens:
                self._frame()

    def _frame(self) -> None:
        if self.held:
            data = np.concatenate(self.held).astype(f"<u{self.width}").tobytes()
            packed = self.packer.compress(data)
            self.out.write(packed)
            self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._frame()
        table = self.packer.compress(bytes([self.width]) + np.array(self.documents, DOCUMENT).tobytes())
        self.out.write(HEAD.pack(DOC_FRAME, len(table)) + table)
        self.entries.append((len(table) + HEAD.size, 0, xxhash.xxh64_intdigest(table) & 0xFFFFFFFF))
        seek = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(HEAD.pack(SKIPPABLE, len(seek)) + seek)


class FrameReader:
    """Reads documents of one file; only frames that hold asked-for ids are read and decompressed, and each is checked."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        raw = self._at(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        entries = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(entries[:, 0])))
        table = self._at(int(starts[n - 1]) + HEAD.size, int(entries[n - 1, 0]) - HEAD.size)
        if xxhash.xxh64_intdigest(table) & 0xFFFFFFFF != entries[n - 1, 2]:
            raise ValueError("the table of documents is damaged")
        table = zstandard.ZstdDecompressor().decompress(table)
        self.width, self.documents = table[0], np.frombuffer(table[1:], DOCUMENT)
        self.entries, self.starts = entries[:-1], starts
        self.first = np.concatenate(([0], np.cumsum(self.entries[:, 1] // self.width)))
        self.cached = (-1, np.zeros(0, "<u2"))

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            packed, size, check = map(int, self.entries[k])
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed))
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.cached = (k, np.frombuffer(data, f"<u{self.width}"))
        return self.cached[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, as unsigned 32-bit numbers."""
        start, n = int(self.documents["start"][k]), int(self.documents["n"][k])
        parts, at = [], int(np.searchsorted(self.first, start, "right")) - 1
        while n > 0:
            ids = self.frame(at)[start - int(self.first[at]) :][:n]
            parts.append(ids)
            start, n, at = start + len(ids), n - len(ids), at + 1
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k, d in enumerate(self.documents):
            yield (None if d["null"] else int(d["doc_id"])), self.document(k)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark spells it; Arrow has other names for some."""
    scheme, sep, rest = path.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}.get(scheme, scheme) + sep + rest)


def _write_batches(batches, folder: str, vocabulary: str, end_id: int, file_tokens: int):
    """Write this task's rows, sorted by id, as files of about file_tokens ids. A file gets its name when it is whole, so a task that runs again replaces it by the same bytes."""
    fs, root = _open(folder)
    tok, end, part, number = tokenizer(vocabulary), np.array([end_id], "<u2"), TaskContext.get().partitionId(), 0
    out = writer = temp = None

    def close():
        nonlocal out, number
        writer.close()
        out.close()
        name = f"{root}/part-{part:06d}-{number:05d}.zst"
        fs.move(temp, name)
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([writer.total], pa.int64()), pa.array([len(writer.documents)], pa.int64())], names=["part", "number", "tokens", "documents"])
        out, number = None, number + 1
        return row

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            if out is None:
                temp = f"{root}/_{uuid.uuid4().hex}"
                out = fs.open_output_stream(temp, compression=None)
                writer = FrameWriter(out)
            writer.add(doc_id, np.concatenate((tok.ids(text.as_py()), end)))
            if writer.total >= file_tokens:
                yield close()
    if out is not None:
        yield close()


def _read_batches(batches, folder: str):
    fs, root = _open(folder)
    for b in batches:
        for part, number, base in zip(*(b.column(k).to_pylist() for k in range(3))):
            with fs.open_input_file(f"{root}/part-{part:06d}-{number:05d}.zst") as f:
                reader, rows = FrameReader(f), []
                for (doc_id, ids), d in zip(reader, reader.documents):
                    rows.append((doc_id, base + int(d["start"]), len(ids), zlib.crc32(ids.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _by_id_range(rows: DataFrame) -> DataFrame:
    """Deal rows to ranges of doc_id, null first. The bounds come from a scan of the ids alone; repartitionByRange would read the texts twice.

    An id that many rows have is several bounds: its rows are dealt over all ranges that end at it, by a hash of their
    text. Null ids have as many ranges as their share asks for. A row's place among the bounds is found in two steps,
    first in every 64th of them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n == 1:
        return rows.repartition(1)
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("b"), F.count("*").alias("all"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    bounds, nulls = found["b"] or [], -(-found["none"] * n // max(1, found["all"]))
    step = 64
    all_, coarse = (F.array(*map(F.lit, x)).cast("array<bigint>") for x in (bounds, bounds[step - 1 :: step]))
    at = F.col("doc_id")
    first = F.size(F.filter(coarse, lambda b: b < at)) * step
    below = first + F.size(F.filter(F.slice(all_, first + 1, step), lambda b: b < at))
    upto = F.size(F.filter(coarse, lambda b: b <= at)) * step
    equal = upto + F.size(F.filter(F.slice(all_, upto + 1, step), lambda b: b <= at)) - below
    salt = F.xxhash64("text")
    place = F.when(at.isNull(), F.pmod(salt, F.lit(max(1, nulls)))).otherwise(nulls + below + F.when(equal > 1, F.pmod(salt, equal + 1)).otherwise(0))
    return rows.repartitionById(n + nulls, place.cast("int"))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, file_tokens: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs to files in folder, in ascending id order (null ids first); returns the files: part, number, base, tokens, documents.

    The texts are dealt to ranges of ids and sorted; base is the number of ids in all files before. The upper sum
    has one row per file. folder must be reachable from all executors (a URI that Arrow knows). Null texts are empty:
    they have the end id only. Repeated ids are documents of their own, in the order of their texts within a file; ids must
    be integers, of any size. Other columns are not looked at. An empty table gives no files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if kind(docs, id_col) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("the files' table of documents holds 64-bit ids: ids must be integers")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _by_id_range(rows).sortWithinPartitions("doc_id", "text")
    files = cut(rows.mapInArrow(partial(_write_batches, folder=folder, vocabulary=vocabulary, end_id=end_id, file_tokens=file_tokens), "part long, number long, tokens long, documents long"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "tokens", "documents")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, decoded from the files; frames are checked."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("part", "number", "base").repartition(n, "part", "number").mapInArrow(partial(_read_batches, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write docs to a fresh folder in the shared place and read all of it back."""
    folder = new_path(docs.sparkSession, "token-ids")
    return read_tokens(write_tokens(docs, folder, vocabulary, **options), folder)
