"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cells, cut, free_name, running_sum


class RemainingTree:
    """Bins ordered by (remaining capacity, bin): a balanced two-level tree, whose leaves split when they grow too large."""

    def __init__(self, leaf: int = 512):
        self.leaf, self.leaves, self.tops = leaf, [[]], []

    def _where(self, item: tuple[int, int]) -> int:
        return min(bisect_left(self.tops, item), len(self.leaves) - 1)

    def add(self, item: tuple[int, int]) -> None:
        k = self._where(item)
        own = self.leaves[k]
        insort(own, item)
        if len(own) > self.leaf:
            half = len(own) // 2
            self.leaves[k : k + 1] = [own[:half], own[half:]]
        self.tops = [x[-1] for x in self.leaves if x] if len(self.leaves) > 1 else []

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds size."""
        k = self._where((size, -1))
        own = self.leaves[k]
        at = bisect_left(own, (size, -1))
        if at == len(own):
            return None
        found = own.pop(at)
        if not own and len(self.leaves) > 1:
            del self.leaves[k]
        self.tops = [x[-1] for x in self.leaves if x] if len(self.leaves) > 1 else []
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """A bin for each size: by falling size, each goes to the fullest bin that still holds it, or opens a new one. None: more than `most` bins."""
    tree, bins, out = RemainingTree(), 0, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[k] > capacity:
            raise ValueError("an item is larger than a bin")
        found = tree.take(sizes[k])
        if found is None:
            if bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        tree.add((found[0] - sizes[k], found[1]))
        out[k] = found[1]
    return out


def even_bins(sizes: list[int], bins: int, rounds: int = 14) -> list[int]:
    """best_fit_decreasing into so many bins, at the smallest capacity, searched by halving, at which they suffice."""
    low = max([-(-sum(sizes) // bins), *sizes, 1])
    if (best := best_fit_decreasing(sizes, low, bins)) is not None:
        return best
    high = low + max([*sizes, 1])
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        high += max(sizes)
    for _ in range(rounds):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        if (found := best_fit_decreasing(sizes, middle, bins)) is None:
            low = middle
        else:
            high, best = middle, found
    return best


def assign(docs: DataFrame, shards: int = 40, most_items: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: the text's bytes (null: none) plus 16. Equal texts (null and empty are equal) are a group, which stays whole;
    a group that no shard can hold is split by a hash of its rows into 16 pieces for each shard it would fill. Groups of 1 / most_items of all bytes or more are
    items by themselves; smaller ones are joined by hash to at most most_items items. So the tree packs a bounded
    number of items, whatever the input: most_items of each kind. slot numbers a shard's rows from 0.
    Ids keep their type. An empty table gives no rows; repeated rows each have a slot.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group"))
    fine = max(4096, 16 * shards)
    rows = cut(rows.withColumn("piece", F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(fine)).cast("int")), "bins-rows")
    parts = cut(rows.groupBy("group", "piece").agg(F.sum("size").alias("size")), "bins-parts")
    groups = cut(parts.groupBy("group").agg(F.sum("size").alias("size")), "bins-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-total // shards))
    whole = -(-total // most_items)
    large = groups.where(F.col("size") >= max(whole, 1)).select("group", (F.col("size") > capacity).alias("split"), F.least(F.ceil(F.col("size") / capacity) * 16, F.lit(fine)).alias("cuts"))
    large = cut(large, "bins-large")  # most_items rows at most
    item = F.when(F.col("split").isNull(), F.concat(F.lit("h"), F.pmod(F.xxhash64("group"), F.lit(most_items)).cast("string"))).when(F.col("split"), F.concat_ws(":", "group", F.floor(F.col("piece") * F.col("cuts") / fine).cast("string"))).otherwise(F.col("group"))
    named = parts.join(F.broadcast(large), "group", "left").withColumn("item", item)
    items = named.groupBy("item").agg(F.sum("size").alias("size")).toPandas().sort_values("item")
    items["shard"] = np.array(even_bins(items["size"].tolist(), shards), np.int32)
    placed = spark.createDataFrame(pa.table({"item": pa.array(items["item"], pa.string()), "shard": pa.array(items["shard"], pa.int32())}))
    out = rows.join(F.broadcast(large), "group", "left").withColumn("item", item).join(F.broadcast(placed), "item", "left")
    n = rows.count()
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 1)
    bits = max(0, (cells(n) // shards).bit_length())
    out = out.withColumns({"key": key, "cell": F.shiftrightunsigned(key, 63 - bits)})
    out = running_sum(out, ["shard"], "cell", [F.col("key"), F.col("doc_id")], F.lit(1).cast("long"), "at")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 40, files: int = 1, id_col: str = "doc_id", **options) -> None:
    """Write docs as Parquet, a folder shard=N for each shard, of `files` files each. Rows are numbered in a work table, so
    those of one id, or of none, are each written once; columns as they are, but for one of the name shard, which would clash."""
    if "shard" in docs.columns:
        raise ValueError("docs has a column shard: the folders' names would hide it")
    row, file = free_name(docs, "_gm_row"), free_name(docs, "_gm_file")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "bins-write")
    where = assign(rows, shards, id_col=row, **options).select(F.col("doc_id").alias(row), "shard")
    bounded_batches(docs.sparkSession)
    placed = rows.join(where, row).withColumn(file, F.pmod(F.xxhash64(row), F.lit(files))).drop(row)
    placed.repartition(shards * files, "shard", file).drop(file).write.partitionBy("shard").parquet(folder)
