"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kind
from .tokens import tokenizer

#: Context sizes of the tiers, each a power of two.
TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Pack documents of the given lengths: windows (size, [(document, start, length), ...]), every one full.

    A document fills windows of the longest tier by itself; its rest is routed to the shortest tier that holds it.
    From the longest tier down, the longest rest opens a window, and its gap takes the longest whole rest that fits
    (of any shorter tier), again and again; then the shortest rest of all is cut to fill what remains, and its other part is
    routed anew. When the rests run out, the last window is cut into windows of smaller powers of two.
    """
    top = tiers[-1]
    pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted

    def route(doc: int, start: int, length: int) -> None:
        if length:
            insort(pool, (length, doc, start))

    rests = []
    for doc, n in enumerate(lengths):
        for at in range(0, n - top + 1, top):
            yield top, [(doc, at, top)]
        if n % top:
            rests.append((n % top, doc, n - n % top))
    pool.extend(sorted(rests))
    while pool:
        longest = pool[-1][0]
        size = next(t for t in tiers if t >= longest)
        gap, window = size, []
        while gap and pool:
            k = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if k >= 0:
                n, doc, start = pool.pop(k)
                window.append((doc, start, n))
                gap -= n
            else:
                n, doc, start = pool.pop(0)
                window.append((doc, start, gap))
                route(doc, start + gap, n - gap)
                gap = 0
        if not gap:
            yield size, window
        else:
            yield from _split(window, size)


def _split(window: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces of a window that is not full, as windows of powers of two."""
    left = sum(n for _, _, n in window)
    rest = list(reversed(window))
    while left:
        while size > left:
            size //= 2
        out, gap = [], size
        while gap:
            doc, start, n = rest.pop()
            take = min(n, gap)
            out.append((doc, start, take))
            if take < n:
                rest.append((doc, start + take, n - take))
            gap -= take
        left -= size
        yield size, out


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """A group for each window so that groups have equal token counts: windows by falling size fill a group up.

    Sizes are powers of two and so is tokens, so each group but the last is exactly full.
    """
    group, held, out = 0, 0, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if held + sizes[k] > tokens:
            group, held = group + 1, 0
        out[k] = group
        held += sizes[k]
    return out


class _Unit:
    """Documents packed together: as many as come until the unit has its number of tokens."""

    def __init__(self, number: int, step_tokens: int, id_type: pa.DataType):
        self.number, self.step_tokens, self.id_type, self.sequences, self.groups = number, step_tokens, id_type, 0, 0
        self.clear()

    def clear(self) -> None:
        self.docs, self.ids, self.tokens = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids.append(ids)
        self.tokens += len(ids)

    def flush(self) -> pa.RecordBatch:
        windows = list(pack([len(x) for x in self.ids]))
        groups = step_groups([size for size, _ in windows], self.step_tokens)
        cols: list[list] = [[] for _ in range(9)]
        base = self.number << 40
        for k, (size, pieces) in enumerate(windows):
            offset = 0
            for doc, start, n in pieces:
                ids = self.ids[doc]
                crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                row = (self.docs[doc], start, n, crc, len(ids), base + self.sequences + k, offset, size, base + self.groups + groups[k])
                for c, v in zip(cols, row):
                    c.append(v)
                offset += n
        self.sequences += len(windows)
        self.groups += max(groups, default=-1) + 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, self.id_type if k == 0 else pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pack_batches(batches, path: str, end_id: int, unit_tokens: int, step_tokens: int):
    tok, unit, end = tokenizer(path), None, np.array([end_id], "<u2")
    for b in batches:
        unit = unit or _Unit(TaskContext.get().partitionId(), step_tokens, b.schema[0].type)
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            unit.add(doc_id, np.concatenate((tok.ids(text.as_py()), end)))
            if unit.tokens >= unit_tokens:
                yield unit.flush()
    if unit and unit.docs:
        yield unit.flush()


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, unit_tokens: int = 4_000_000, step_tokens: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    Documents are encoded (end_id follows each; null is empty) and packed where they lie, in units of a bounded number
    of tokens: no shuffle, and no task holds more than a unit. Every sequence has as many tokens as its window, a power
    of two, so nothing is padded. Sequences of a step group have step_tokens tokens in all, but for each unit's last
    group. sequence_id and step_group number the task's partition in their high bits; a task that runs again on the
    same input gives the same rows. Ids keep their type. Repeated rows are documents of their own. An empty table gives no
    rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_pack_batches, path=path, end_id=end_id, unit_tokens=unit_tokens, step_tokens=step_tokens), SCHEMA.format(kind(docs, id_col)))
