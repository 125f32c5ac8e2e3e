"""A training corpus from raw documents: quality rules, exact dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import fair_mix, lsm_dedup, quality, simhash_ball, tier_packing
from gristmill.llm.common import new_path
from gristmill.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go; a null language or source is a group of its own. Very long texts are measured
    whole. Ties: none. Repeated rows, and rows of one id, are judged each on their own. Empty tables give none. Other
    columns stay, whatever their names.
    """
    return quality.quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, of equally long ones the smallest id (null last).

    Null texts are empty ones and equal to texts of white space. Texts of any length are hashed whole. Of repeated rows one
    stays. Empty tables give none. Other columns stay, whatever their names.
    """
    return lsm_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id (null last), of one id the least hash of the text.

    Null and wordless texts share one fingerprint, so one of them stays. Texts of any length are read whole. Of repeated rows
    one stays. Empty tables give none. Other columns stay, whatever their names.
    """
    return simhash_ball.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: never, once or twice.

    Null and empty texts have no words and are taken no more than others of size 0; a null source is a source, the last.
    Ties of finish times go by a hash of id and text, so reruns agree. Very long texts count by their words, and a
    document that the budget ends in is taken whole or not. Repeated rows are documents each. Empty tables give none.
    Other columns stay, whatever their names.
    """
    return fair_mix.mixed_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in full windows of several lengths.

    Null texts are empty: a document of its end token alone. Very long texts are cut over as many windows as they need.
    Ties and repeated rows, as those that the mixture takes twice, are packed each. Empty tables give no pieces. Columns
    other than id and text are not looked at.
    """
    return tier_packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has no fingerprints by majority of hash bits; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
