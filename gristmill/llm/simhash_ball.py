"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut, kind, one_of_each

#: Fingerprints link at this many differing bits or fewer.
RADIUS = 3
ONE = np.uint64(1)
BITS = np.left_shift(ONE, np.arange(64, dtype=np.uint64))
#: Two different bits, each pair once.
PAIRS = np.array([BITS[a] | BITS[b] for a in range(64) for b in range(a)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included: a bit is set if it is in over half the shingles' XXH64 (seed 42). No words: 0."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, split at \x20 and \x09-\x0D
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _print_batches(batches):
    for b in batches:
        prints = np.array([fingerprint(x) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint's bits as a signed long) per row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_print_batches, f"doc_id {kind(docs, id_col)}, key long, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: neighbouring keys go to unrelated buckets."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt(key: np.ndarray, value: np.ndarray, buckets: int):
    """Rows (bucket, packed pairs): what goes to one bucket travels as one value."""
    bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    pairs = np.stack([key[order], value[order]], axis=1)
    own, at = np.unique(bucket[order], return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in np.split(pairs, at[1:])], pa.binary())], names=["bucket", "pairs"])


def _sieve_emit(batches, buckets: int):
    """Each fingerprint's ball of radius 1 on 48 of the 64 bits, for each of the four 16-bit blocks left out.

    Of 3 differing bits one lies in some block; without it 2 are left, and the balls of half that radius meet.
    """
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 4096):
            part = fp[k : k + 4096]
            keys = []
            for block in range(4):
                mask = np.uint64(0xFFFF << (16 * block))
                kept = (part & ~mask) | np.uint64(block << (16 * block))
                flips = np.concatenate(([np.uint64(0)], BITS[(BITS & mask) == 0]))
                keys.append((kept[:, None] ^ flips[None, :]).ravel())
            values = np.tile(np.repeat(part, 49), 4)
            yield _dealt(np.concatenate(keys), values, buckets)


def _pairs(batches):
    """The packed pairs of each bucket in turn, sorted by key and value; rows come sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now and held:
                yield _sorted(held)
                held = []
            now = bucket
            held.append(np.frombuffer(data.as_buffer(), np.uint64).reshape(-1, 2))
    if held:
        yield _sorted(held)


def _sorted(held: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(held)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _sieve_meet(batches):
    """Fingerprints that share a variant with another one."""
    for pairs in _pairs(batches):
        key, fp = pairs[:, 0], pairs[:, 1]
        meets = np.zeros(len(fp), bool)
        same = key[1:] == key[:-1]
        meets[1:] |= same
        meets[:-1] |= same
        if meets.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp[meets]).view(np.int64))], names=["fp"])


def _ball_emit(batches, buckets: int):
    """The whole-width balls: radius 1 for every fingerprint, and radius 2 for those with an odd number of ones.

    Two fingerprints 2 bits apart meet in balls of radius 1. Those 1 or 3 bits apart have one odd side: its ball of
    radius 2 meets the other's ball of radius 1. The top bit of the value's companion key tells the two kinds apart.
    """
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 1024):
            part = fp[k : k + 1024]
            odd = part[np.bitwise_count(part) % 2 == 1]
            near = np.concatenate((part, (part[:, None] ^ BITS[None, :]).ravel()))
            far = (odd[:, None] ^ PAIRS[None, :]).ravel()
            yield _dealt(np.concatenate((near, far)), np.concatenate((part, np.repeat(part, 64), np.repeat(odd, len(PAIRS)))), buckets)


def _ball_meet(batches):
    """Links that connect what meets at a variant: its first fingerprint within 1 bit of it, to all others there.

    All of these are within 1 + 2 bits of that one; this is verified again. A variant has 2081 fingerprints at most.
    """
    for pairs in _pairs(batches):
        key, fp = pairs[:, 0], pairs[:, 1]
        near = np.bitwise_count(key ^ fp) <= 1
        first = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(first) - 1
        centre = np.full(group[-1] + 1, -1, np.int64)
        at = np.flatnonzero(near)[::-1]
        centre[group[at]] = at
        has = centre[group] >= 0
        a, c = fp[has], fp[centre[group[has]]]
        ok = (a != c) & (np.bitwise_count(a ^ c) <= RADIUS)
        if ok.any():
            links = np.unique(np.stack([np.maximum(a[ok], c[ok]), np.minimum(a[ok], c[ok])], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _shuffled(emitted: DataFrame, buckets: int, tasks: int) -> DataFrame:
    return emitted.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def links(fps: DataFrame, bucket_pairs: int = 1 << 20) -> DataFrame:
    """Links (a, b) whose components are those of all distinct fingerprints (column fp) at RADIUS bits or fewer.

    First a sieve: balls on part of the bits name the fingerprints that may have a neighbour. Then these alone emit
    whole balls. Both shuffle on the variants, in buckets of a bounded number of them.
    """
    spark = fps.sparkSession
    bounded_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(rows: DataFrame, each: int) -> tuple[DataFrame, int]:
        n = rows.count()
        return rows, max(256, -(-n * each // bucket_pairs))

    fps, buckets = spread(fps, 196)
    met = _shuffled(fps.mapInArrow(partial(_sieve_emit, buckets=buckets), "bucket int, pairs binary"), buckets, max(tasks, buckets // 8))
    active, buckets = spread(cut(met.mapInArrow(_sieve_meet, "fp long").distinct(), "ball-active"), 1073)
    met = _shuffled(active.repartition(tasks).mapInArrow(partial(_ball_emit, buckets=buckets), "bucket int, pairs binary"), buckets, max(tasks, buckets // 8))
    return cut(met.mapInArrow(_ball_meet, "a long, b long").distinct(), "ball-links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, fp, root (the component's smallest fp), key.

    component_id is the smallest id that is reachable over links of fingerprints at 3 or fewer differing bits. Null,
    empty and wordless texts have the fingerprint 0, which links like any other. Equal fingerprints are one node, so
    copies cost one ball. Null ids are no one's smallest id, unless all ids of a component are null. Ids keep their
    type, one that can be ordered. Repeated rows each have a row. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col), "ball-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "ball-nodes")
    roots = components(links(nodes.select("fp")), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(groups, "root").select("fp", "component_id", "root"), "ball-named")
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "root", "key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, that with the smallest id; columns as they are.

    Rows are told apart by id and a hash of their text. Rows without an id come last; of rows of one id in a group one
    stays, the one of the least hash, and of repeated rows one.
    """
    found = cut(near_groups(docs, id_col, text_col).select("root", "doc_id", "key"), "ball-rows")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("keep"))
    stay = cut(first.select(F.col("keep.doc_id").alias("_gm_id"), F.col("keep.key").alias("_gm_key")), "ball-stay")
    each = found.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_gm_id"]) & (a["key"] == b["_gm_key"])
    gone = each.join(stay, same(each, stay), "left_anti").select(F.col("doc_id").alias("_gm_id"), F.col("key").alias("_gm_key"))
    here = lambda b: docs[id_col].eqNullSafe(b["_gm_id"]) & (F.xxhash64(docs[text_col]) == b["_gm_key"])
    gone = cut(gone, "ball-gone")
    out = docs.join(gone, here(gone), "left_anti")
    again = cut(each.where("n > 1").select(F.col("doc_id").alias("_gm_id"), F.col("key").alias("_gm_key")), "ball-again")
    if again.isEmpty():
        return out
    once = one_of_each(out.join(again, here(again), "left_semi"), [F.col(id_col), F.xxhash64(text_col)], F.char_length(F.coalesce(text_col, F.lit(""))))
    return out.join(again, here(again), "left_anti").unionByName(once)
