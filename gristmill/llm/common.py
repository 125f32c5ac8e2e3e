"""Shared parts of the training-data operators: work tables, prefix sums, lookups, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that the operators split words at, as a Java character class.
SPACE = r"\x20\x09-\x0D"

_fallback: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: spark.checkpoint.dir. Unset: a temp folder on a local master, else the warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        _fallback[key] = f"file://{tempfile.mkdtemp(prefix='gristmill-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return _fallback[key]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; the JVM removes it when the application ends."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as a work table and read it back: later steps start from the shared folder, whatever executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove work tables from which all that is needed has been written; shuffle files go as well, once the driver has
    forgotten the plans that they belong to."""
    for t in tables:
        spark = t.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._gm_path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Python workers get Arrow batches of at most so many rows and bytes, so one batch of long texts can't fill memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def kind(df: DataFrame, column: str) -> str:
    """A column's type, as schemas spell it."""
    return df.select(column).schema[0].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def one_of_each(docs: DataFrame, keys: list[Column], length: Column) -> DataFrame:
    """One row of those with equal keys: the longest, and of equally long ones any. Columns as they are."""
    own = [f"_gm_k{k}" for k in range(len(keys))]
    rows = docs.withColumns(dict(zip(own, keys)))
    best = rows.groupBy(*own).agg(F.max_by(F.struct(*(f"`{c}`" for c in docs.columns)), length).alias("_gm_row"))
    return best.select("_gm_row.*")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cells(rows: int, least: int = 64, each: int = 512, most: int = 1 << 20) -> int:
    """Into how many cells a total order over so many rows is cut: small ones for few rows, never more than most."""
    return max(least, min(most, -(-rows // each)))


def running_sum(df: DataFrame, keys: list[str], cell: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of value within keys, in the order of (cell, *order), as column out.

    Two levels: sums per (keys, cell) are summed up before the rows are, so no task holds more than one cell
    of rows, and the upper level has one row per cell. keys and cell must not be null.
    """
    by = [*keys, cell]
    sums = df.groupBy(*by).agg(F.sum(value).alias("_gm_sum"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, F.coalesce(F.sum("_gm_sum").over(over), F.lit(0).cast("long")).alias("_gm_base"))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(base, by).withColumn(out, F.col("_gm_base") + F.sum(value).over(inner)).drop("_gm_base")


def lookup(big: DataFrame, small: DataFrame, key: str, salt: Column, most: int = 200_000, salts: int = 64) -> DataFrame:
    """Left join of big with small on a null-safe key that small has once.

    small is counted: up to `most` rows it is broadcast; beyond, it is copied to `salts` salts and big's rows are
    dealt over them, so a hot key meets its one row in many tasks.
    """
    other = small.withColumnRenamed(key, "_gm_key")
    if small.count() <= most:
        return big.join(F.broadcast(other), big[key].eqNullSafe(other["_gm_key"]), "left").drop("_gm_key")
    other = other.withColumn("_gm_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_gm_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    on = dealt[key].eqNullSafe(other["_gm_key"]) & (dealt["_gm_salt"] == other["_gm_copy"])
    return dealt.join(other, on, "left").drop("_gm_key", "_gm_copy", "_gm_salt")


def spread_join(big: DataFrame, small: DataFrame, key: str, count: str, parts: int = 4096, most: int = 500_000) -> DataFrame:
    """Inner join of big with small on a key that small has once; count says how many rows of big have it.

    Up to `most` rows of small are broadcast. Beyond that, keys with more than a share of 1 / parts of the counted rows,
    of which there can be no more than `parts`, are broadcast, so that the join by key meets none of them.
    """
    one = small.agg(F.count("*").alias("n"), F.sum(count).alias("rows")).first()
    if one["n"] <= most:
        return big.join(F.broadcast(small), key)
    least = one["rows"] // parts
    hot, cold = small.where(F.col(count) > least), small.where(F.col(count) <= least)
    if hot.isEmpty():
        return big.join(cold, key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rest.unionByName(big.join(F.broadcast(hot), key).select(*rest.columns))


def components(edges: DataFrame, a: str, b: str, label: str = "stars") -> DataFrame:
    """Connected components of undirected edges: one row (node, root) per node that has an edge; root is the smallest node.

    Alternating large-star and small-star steps, each cut to a work table. Minima are pre-aggregated, and the joins
    that follow have no aggregation above them on the same key, so adaptive execution may split a hub's rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, pairs = pairs, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(old, large)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    rooted = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
