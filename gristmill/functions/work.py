"""Work tables: lineage is cut by writing a table in the shared folder and reading it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset: a temp folder on a local master, else the warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        _fallback[key] = f"file://{tempfile.mkdtemp(prefix='gristmill-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return _fallback[key]


def cut(df: DataFrame, label: str = "work") -> DataFrame:
    """df as a work table; later steps start from it, whatever executors are lost. It is removed when the application ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
