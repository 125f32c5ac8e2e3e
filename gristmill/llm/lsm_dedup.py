"""Exact dedup through a log-structured merge index of text digests. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name, kind, new_path, one_of_each


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best(*then: str) -> Column:
    """The row that stays: longest text, then smallest id, null last, then the columns named."""
    return F.min(F.struct((-F.col("length")).alias("n"), F.col("id").isNull().alias("none"), "id", *then)).alias("best")


class DigestIndex:
    """A log-structured merge index over (digest, length, id).

    flush() writes a batch as level 0: each input partition is a memtable, sorted by digest and split into runs of at
    most `memtable` rows, with Parquet's Bloom filter and min/max on the digest as each run's filters. compact() merges
    the runs since the last compaction with the level 1 of then into a new level 1: one entry per digest with the row
    that stays (longest text, then smallest id) and the number of rows. The filters let lookup() skip runs: of single
    digests, or of a batch's, whose digests are pushed down as a list while they are few and else joined.
    """

    def __init__(self, spark: SparkSession, memtable: int = 1_000_000, id_type: str = "bigint"):
        self.spark, self.memtable, self.path, self.batches, self.merged, self.id_type = spark, memtable, new_path(spark, "lsm"), 0, 0, id_type

    def _write(self, rows: DataFrame, level: int, part: int) -> None:
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        rows.sortWithinPartitions("digest").write.options(compression="zstd", maxRecordsPerFile=self.memtable, **bloom).parquet(f"{self.path}/{level}/{part}")

    def flush(self, entries: DataFrame) -> None:
        """entries: digest string, id long, length long. Each gets a row number that no other has."""
        rows = entries.select("digest", "id", "length", (F.monotonically_increasing_id() + F.lit(self.batches << 56)).alias("row"))
        self._write(rows, 0, self.batches)
        self.batches += 1

    def _read(self, level: int, parts: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{level}/{n}" for n in range(parts)))

    def runs(self) -> DataFrame:
        return self._read(0, self.batches, f"digest string, id {self.id_type}, length long, row long")

    def level1(self) -> DataFrame:
        """digest, keep_id, keep_row, keep_length, group_size as of the last compaction."""
        return self.spark.read.schema(f"digest string, keep_id {self.id_type}, keep_row long, keep_length long, group_size long").parquet(f"{self.path}/1/{self.merged}")

    def compact(self) -> DataFrame:
        """Merge the new runs with level 1 into the next level 1, which is returned. Nothing new: level 1 as it is."""
        if self.batches > self.merged:
            new = [f"{self.path}/0/{n}" for n in range(self.merged, self.batches)]
            entries = self.spark.read.schema(self.runs().schema).parquet(*new).withColumn("n", F.lit(1).cast("long"))
            if self.merged:
                old = self.level1().select("digest", F.col("keep_id").alias("id"), F.col("keep_length").alias("length"), F.col("keep_row").alias("row"), F.col("group_size").alias("n"))
                entries = entries.unionByName(old)
            best = entries.groupBy("digest").agg(_best("row"), F.sum("n").alias("group_size"))
            self._write(best.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), (-F.col("best.n")).alias("keep_length"), "group_size"), 1, self.batches)
            self.merged = self.batches
        return self.level1()

    def lookup(self, digests: list[str]) -> DataFrame:
        """The runs' entries of a few digests; the runs' filters are pushed down."""
        return self.runs().where(F.col("digest").isin(digests))

    def seen(self, batch: DataFrame, most: int = 1000) -> DataFrame:
        """Entries of level 1 whose digests a batch (column digest) has: what a batch is probed with before it is flushed."""
        wanted = batch.select("digest").distinct()
        few = wanted.limit(most + 1).collect()
        if len(few) <= most:
            return self.level1().where(F.col("digest").isin([r["digest"] for r in few]))
        return self.level1().join(wanted, "digest", "left_semi")


def _verified(hits: DataFrame) -> DataFrame:
    """Byte verification: digests whose texts are not all the same bytes. Texts meet their group in map-side minima and maxima."""
    return hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, memtable: int = 1_000_000, most_buckets: int = 16_384, most_hits: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are identical after deleting ASCII white space; null is empty. Of a group the row with
    the most code points of original text stays, then the one with the smallest id (a null id is last), then the row read
    first; repeated rows each count in group_size. Ids keep their type, which must be one that can be ordered. Other
    columns are not looked at. An empty table gives no rows.

    Hits, digests of more than one row, are compared by their bytes; groups in which a digest stands for several texts
    are split by the texts themselves. Which texts are hits is told by bitmaps over their ids where ids are long and
    lie close together (most_buckets of 32768 ids at most), and else by a join on the digest, hits being broadcast up
    to most_hits of them.
    """
    spark = docs.sparkSession
    id_type = kind(docs, id_col)
    index = DigestIndex(spark, memtable, id_type)
    entries = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    entries = entries.select("id", F.char_length("text").cast("long").alias("length"), normalised(F.col("text")).alias("norm"))
    index.flush(entries.select(digest(F.col("norm")).alias("digest"), "id", "length"))
    level1 = index.compact()
    out = index.runs().join(level1.drop("keep_length"), "digest", "left")
    hits = level1.where("group_size > 1")
    broken = cut(_verified(_hit_texts(entries, index, hits, digest, most_buckets, most_hits)), "lsm-broken")
    if not broken.isEmpty():
        return _pick(_resolved(entries, out, broken, digest))
    return _pick(out)


def _hit_texts(entries: DataFrame, index: DigestIndex, hits: DataFrame, digest: Callable[[Column], Column], most_buckets: int, most_hits: int) -> DataFrame:
    """digest, norm of the rows of hits (and a few more, which do no harm)."""
    member = index.runs().join(hits.select("digest"), "digest", "left_semi")
    if index.id_type == "bigint":
        # Rows of hits as bitmaps over their ids, 4 KB for 32768 ids: the second pass over the texts needs no shuffle of them.
        some = member.where("id is not null and id >= 0")
        buckets = some.agg(F.count_distinct(F.bitmap_bucket_number("id")).alias("n")).first()["n"]
        if buckets <= most_buckets:
            maps = cut(some.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")), "lsm-hits")
            texts = entries.withColumn("bucket", F.bitmap_bucket_number("id")).join(F.broadcast(maps), "bucket", "left")
            at = F.bitmap_bit_position("id")
            byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = F.col("id").isNull() | (F.col("id") < 0) | (F.getbit(byte, (at % 8).cast("int")) == 1)
            return texts.where(hit).select(digest(F.col("norm")).alias("digest"), "norm")
    wanted = cut(hits.select("digest"), "lsm-wanted")
    few = wanted.count() <= most_hits
    return entries.select(digest(F.col("norm")).alias("digest"), "norm").join(F.broadcast(wanted) if few else wanted, "digest", "left_semi")


def _resolved(entries: DataFrame, out: DataFrame, broken: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of out, with groups by text where a digest stands for several texts."""
    rows = entries.withColumn("digest", digest(F.col("norm"))).join(broken, "digest", "left_semi")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "lsm-texts")
    groups = rows.groupBy("digest", "norm").agg(_best("row"), F.count("*").alias("group_size"))
    groups = groups.select("digest", "norm", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    fixed = rows.join(groups, ["digest", "norm"]).select(*out.columns)
    return out.join(broken, "digest", "left_anti").unionByName(fixed)


def _pick(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "length")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, see exact_groups; columns as they are, whatever their names."""
    own = free_name(docs, "_gm_digest")
    mine, key = docs.withColumn(own, sha256(normalised(F.col(text_col)))), [F.col("doc_id"), F.col("digest")]
    seen = cut(exact_groups(docs, id_col, text_col).where("group_size > 1"), "lsm-groups")
    by = seen.groupBy(*key).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))

    def on(found: DataFrame):
        return docs[id_col].eqNullSafe(found["doc_id"]) & (mine[own] == found["digest"])

    gone = by.where("not kept")
    out = mine.join(gone, on(gone), "left_anti")
    again = by.where("kept and n > 1")  # one id and one text in several rows
    if not again.isEmpty():
        once = one_of_each(out.join(again, on(again), "left_semi"), [F.col(id_col), F.col(own)], F.char_length(F.coalesce(text_col, F.lit(""))))
        out = out.join(again, on(again), "left_anti").unionByName(once)
    return out.drop(own)
