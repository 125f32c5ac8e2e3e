"""Curation of a stream: stateless checks and redaction, then exact dedup within a watermark, or exact or near dedup against what was kept before."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import redact, strip
from ..functions.work import cut
from ..operators import dedup
from ..operators.analysis import positions


def curate_stream(stream: DataFrame, time: str, text: str = "text", delay: str = "1 hour") -> DataFrame:
    """Rows with text, redacted; a copy of a text that came within `delay` is dropped. State is a digest per text, bounded by the watermark."""
    rows = stream.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn(text, redact(F.col(text)))
    rows = rows.withColumn("_key", F.sha2(strip(F.col(text)), 256)).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def append_new(stream: DataFrame, target: str, checkpoint: str, order: str, text: str = "text") -> StreamingQuery:
    """Append to a Parquet folder what no earlier batch has kept: of each batch the first row, by order (nulls first, one of
    equal ones), of each new text.

    The folder has a column _key, the text's digest, to find copies by. A batch that is repeated after a failure finds its
    own rows there and adds none twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_key", F.sha2(strip(F.col(text)), 256))
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "stream")
        place = F.struct(F.col(order).isNotNull().alias("some"), F.col(order).alias("order"), "_row")
        first = rows.groupBy("_key").agg(F.min(place)["_row"].alias("_row")).select("_row")
        rows = rows.join(first, "_row", "left_semi").drop("_row")
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(target).select("_key"), "_key", "left_anti")
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Shingles of a batch that are broadcast to find kept rows by, at most.
MOST_SHINGLES = 5_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_near(stream: DataFrame, target: str, checkpoint: str, order: str, text: str = "text", t: float = 0.88, trigger: dict | None = None) -> StreamingQuery:
    """Append to a Parquet folder the rows that near_keep keeps: those without an earlier kept row at a Jaccard similarity of t.

    Rows are taken batch by batch, and in a batch by order (nulls first, of equal ones any first). The folder has rows/batch=N
    with a number _seq for each row, and shingles/batch=N, the first shingles of kept rows in the order of their hashes, by which
    kept rows are found again: only those that share one with a batch are compared with it. A batch writes its own two
    partitions anew and reads earlier ones alone, so a batch that is repeated after a failure gives the same rows once.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(positions(batch, order, "_seq").withColumn("_seq", F.col("_seq") + F.lit(number << 40)), "stream-rows")
        if rows.isEmpty():
            return
        fields = "ord long, n int, digest binary, prefix array<long>"
        first = partial(dedup._shingle_rows, t=t, common=(np.zeros(0, np.int64), np.zeros(0, np.int64)), names=["ord", "n", "digest", "prefix"])
        shingles = lambda df: df.select(F.col("_seq").alias("ord"), F.col(text).alias("text")).mapInArrow(first, fields).select("ord", F.explode("prefix").alias("h"))
        own, met = cut(shingles(rows), "stream-shingles"), None
        if _exists(spark, f"{target}/shingles"):
            wanted = own.select("h").distinct()
            wanted = F.broadcast(wanted) if wanted.count() <= MOST_SHINGLES else wanted
            before = F.col("batch") < number
            near = cut(spark.read.parquet(f"{target}/shingles").where(before).join(wanted, "h", "left_semi").select("ord").distinct(), "stream-near")
            met = spark.read.parquet(f"{target}/rows").where(before).join(near, F.col("_seq") == F.col("ord"), "left_semi").select("_seq", text)
        both = rows.select("_seq", text) if met is None else rows.select("_seq", text).unionByName(met)
        kept = cut(dedup.near_keep(both, "_seq", text, t).where("keep").select("ord"), "stream-kept")
        for name, df, on in (("shingles", own, own["ord"] == kept["ord"]), ("rows", rows, rows["_seq"] == kept["ord"])):
            df.join(kept, on, "left_semi").write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
