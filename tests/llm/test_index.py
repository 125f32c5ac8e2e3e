from pyspark.sql import functions as F

from gristmill.llm import lsm_dedup


def entries(spark, lo, hi, length=5):
    return spark.range(lo, hi).select(F.concat(F.lit("d"), F.col("id") % 7).alias("digest"), "id", F.lit(length).cast("long").alias("length"))


def test_levels_merge_step_by_step(spark):
    """Compacting after each batch gives what one compaction of all batches gives, and reads no old run again."""
    step, whole = lsm_dedup.DigestIndex(spark, memtable=4), lsm_dedup.DigestIndex(spark, memtable=4)
    for k in range(3):
        batch = entries(spark, 10 * k, 10 * k + 10, length=5 + k)
        step.flush(batch)
        whole.flush(batch)
        out = step.compact()
    want = {r.digest: (r.keep_id, r.keep_length, r.group_size) for r in whole.compact().collect()}
    assert {r.digest: (r.keep_id, r.keep_length, r.group_size) for r in out.collect()} == want
    assert {r.digest: (r.keep_id, r.keep_length, r.group_size) for r in step.compact().collect()} == want
    assert sum(n for _, _, n in want.values()) == 30 and all(length == 7 for _, length, _ in want.values())


def test_batches_are_probed(spark):
    index = lsm_dedup.DigestIndex(spark)
    index.flush(entries(spark, 0, 4))
    index.compact()
    batch = spark.createDataFrame([("d1",), ("d1",), ("d6",)], "digest string")
    assert {r.digest for r in index.seen(batch).collect()} == {r.digest for r in index.seen(batch, most=1).collect()} == {"d1"}
