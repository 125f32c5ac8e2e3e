"""Embedding near-dedup by spherical-cap filters with structured random product codes.

A filter is a direction; a vector passes those that it is close to. The directions are all combinations of a few random
code words, one for each part of the dimensions, so a vector's filters are decoded from its products with these words.
Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut, lookup, partitions

#: Vectors of a filter that are compared in one piece.
TILE = 1024


class Plan(NamedTuple):
    """share: of all directions that pass a filter; filters: how many a code has; codes: independent ones; seed of their words."""

    share: float
    filters: int
    codes: int
    seed: int


def plan(vectors: int, each: int = 12, meet: int = 24, codes: int | None = None, seed: int = 5) -> Plan:
    """Of each code a vector passes `each` filters on average, and a filter has `meet` vectors that have nothing to do with
    each other, whatever their number. So filters are narrower for more vectors; one code more for ten times as many makes up for it."""
    share = min(0.05, meet / max(1, vectors))
    return Plan(share, max(each, round(each / share)), codes or max(3, math.ceil(math.log10(max(1, vectors))) - 2), seed)


@lru_cache(16)
def _cap(d: int, share: float) -> float:
    """The cosine above which a random direction is with probability `share`."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((d - 3) / 2)
    upper = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(t[np.searchsorted(-upper, -share)])


@lru_cache(64)
def _code(d: int, filters: int, *seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and the code words of each part: as many parts as keep a part's words below about 2,000. Fewer parts give filters that depend less on each other."""
    rng = np.random.default_rng([*seed, d])
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    parts = next((m for m in (2, 3, 4) if filters <= 2000**m), 5)
    words = []
    for p in np.array_split(np.arange(d), parts):
        w = rng.standard_normal((round(filters ** (1 / parts)) + 1, len(p)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(parts))
    return rotation, words


def decode(x: np.ndarray, p: Plan, code: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and filters, for all filters of a code that unit vectors pass: part by part, without what can't pass any more."""
    k, size = x.shape
    x = np.pad(x, ((0, 0), (0, max(0, 8 - size))))
    rotation, words = _code(x.shape[1], p.filters, p.seed, code)
    least, turned = _cap(x.shape[1], p.share), x @ rotation
    bounds = np.cumsum([w.shape[1] for w in words])[:-1]
    products = [part @ w.T for part, w in zip(np.split(turned, bounds, axis=1), words)]
    rest = np.zeros((len(words) + 1, k))
    for j in range(len(words) - 1, -1, -1):
        rest[j] = rest[j + 1] + products[j].max(axis=1)
    row, total, number = np.arange(k), np.zeros(k), np.zeros(k, np.int64)
    for j, s in enumerate(products):
        sums = total[:, None] + s[row]
        at, word = np.nonzero(sums >= (least - rest[j + 1][row])[:, None])
        row, total, number = row[at], sums[at, word], number[at] * s.shape[1] + word
    return row, number | np.int64(size) << np.int64(44) | np.int64(code) << np.int64(40)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filtered(batches, p: Plan) -> Iterator[pa.RecordBatch]:
    """node, n, vector, filters (in order); vectors of other lengths meet other filters."""
    for b in batches:
        sizes = np.array([len(v) for v in b.column("vector")])
        for d in np.unique(sizes):
            of = b.filter(pa.array(sizes == d))
            for k in range(0, len(of), 128):
                part = of.slice(k, 128)
                x = _vectors(part.column("vector"))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, number = (np.concatenate(z) for z in zip(*(decode(x, p, code) for code in range(p.codes))))
                order = np.lexsort((number, row))
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                filters = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(number[order]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "n", "vector")), filters], names=["node", "n", "vector", "filters"])


def _counted(linked: np.ndarray, lists: pa.ListArray, this: int) -> np.ndarray:
    """Of the links of a connected group those whose two vectors pass no filter before this one together."""
    owner, number = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    owner, number = owner[number < this], number[number < this]
    _, column, times = np.unique(number, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    passes = np.zeros((len(lists), column.max() + 1 if len(column) else 0), np.float32)
    passes[owner, column] = 1
    return linked & (passes @ passes.T == 0)


def _compared(held: list[pa.RecordBatch], least: float) -> pa.RecordBatch | None:
    """node, links (weighted by copies) and root (a node of the piece that it is connected to) of the vectors of one piece that have links.

    A pair's links are counted at the first filter that both pass; its connection counts everywhere.
    """
    whole = pa.Table.from_batches(held).combine_chunks()
    node, n, part = (whole.column(c).to_numpy() for c in ("node", "n", "part"))
    if len(node) < 2:
        return None
    this, a, b = (whole.column(c)[0].as_py() for c in ("filter", "a", "b"))
    x = _vectors(whole.column("vector").chunk(0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    if a != b:
        linked &= part[:, None] != part[None, :]
    np.fill_diagonal(linked, False)
    has = linked.any(axis=1)
    if not has.any():
        return None
    at = np.flatnonzero(has)
    linked, node, n = linked[np.ix_(at, at)], node[at], n[at]
    label = np.arange(len(at))
    while True:  # the least row of each connected group
        new = np.minimum(label, np.where(linked, label[None, :], len(at)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    lists, links = whole.column("filters").chunk(0).take(pa.array(at)), np.zeros(len(at))
    order = np.argsort(label, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        links[g] = _counted(linked[np.ix_(g, g)], lists.take(pa.array(g)), this) @ n[g].astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(node[label])], names=["node", "links", "root"])


def _meet(batches, least: float) -> Iterator[pa.RecordBatch]:
    """What is linked in each piece (filter, a, b); rows come sorted by it."""
    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("filter", "a", "b")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if hi > lo:
                key = tuple(keys[lo])
                if key != now:
                    if held and (out := _compared(held, least)) is not None:
                        yield out
                    now, held = key, []
                held.append(batch.slice(lo, hi - lo))
    if held and (out := _compared(held, least)) is not None:
        yield out


def near_vectors(embeddings: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, **options) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links (other vectors at a cosine of `least` or more), component_id (the smallest id that is reachable), kept (vec_id = component_id).

    Cosines are compared in double precision. Equal vectors are one node with copies, so a vector that many rows have is
    compared once; a filter that more than `tile` vectors pass is cut into pieces, each pair of which is a group of its
    own. No pair below `least` is linked; one above it is missed if the two share no filter (options are those of plan).

    Vectors that are null, empty or zero or have null or non-finite components link with nothing: n_links 0 and their own
    id. Vectors of different lengths never link. Ids keep their type, one that can be ordered; a null id is no one's
    smallest id unless all of a component are, and is not kept. Repeated rows link with each other. Other columns don't
    matter. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    v = F.col("vector")
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    nodes = rows.where(sound).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "cap-nodes")
    p = plan(nodes.count(), **options)
    named = cut(nodes.select("node", "n", "vector").mapInArrow(partial(_filtered, p=p), f"node long, n long, vector {nodes.schema['vector'].dataType.simpleString()}, filters array<long>"), "cap-filters")
    each = named.select("node", "n", "vector", "filters", F.explode("filters").alias("filter"))
    large = cut(each.groupBy("filter").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("filter", F.ceil(F.col("size") / tile).cast("int").alias("parts")), "cap-large")
    placed = lookup(each, large, "filter", F.col("node")).withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("a"), F.greatest(o, "part").alias("b")))
    pieces = placed.select("filter", "part", "node", "n", "vector", "filters", F.explode(pairs).alias("q")).select("filter", "q.a", "q.b", "part", "node", "n", "vector", "filters")
    dealt = pieces.repartition(partitions(embeddings), "filter", "a", "b").sortWithinPartitions("filter", "a", "b")
    met = cut(dealt.mapInArrow(partial(_meet, least=least), "node long, links long, root long"), "cap-links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("node <> root").select("node", "root"), "node", "root", "cap-stars").withColumnRenamed("root", "top")
    whole = nodes.join(links, "node", "left").join(roots, "node", "left").select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("top", "node").alias("top"))
    whole = cut(whole, "cap-whole")
    least_of = whole.groupBy("top").agg(F.min("least").alias("component_id"))
    result = whole.join(least_of, "top").select(F.col("vector").alias("_v"), F.col("n_links").alias("_n"), "component_id")
    out = rows.join(result, F.when(sound, v) == F.col("_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
