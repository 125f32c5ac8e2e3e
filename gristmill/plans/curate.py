"""The curation plan: validate, redact, dedup, score, filter; rejected rows carry their stage and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact, strip
from ..functions.work import cut
from ..operators import dedup, records, rules


@dataclass(frozen=True)
class CurateConfig:
    dedup_method: str = "exact"  # exact, near or off
    threshold: float = 0.88
    min_score: float = 6.0
    redact_pii: bool = True
    validate: bool = True  # without it, records of no usable text meet the other stages


def redacted(rows: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """rows of to_records with prompt, response and classify_text redacted and content made of them again, each text redacted once."""
    fmt = rows.schema["fmt"].metadata.get("constant")
    if fmt == "raw":  # one text is response and classify_text, and there is no prompt
        rows = rows.withColumn("response", redact(F.col("response"), entities))
        rows = rows.withColumn("classify_text", F.col("response")).withColumn("_stripped", strip(F.col("response")))
        return rows.withColumn("content", F.when(F.col("_stripped") != "", F.col("_stripped")).otherwise(F.col("response"))).drop("_stripped")
    return records.with_content(rows.withColumns({c: redact(F.col(c), entities) for c in ("prompt", "response", "classify_text")}))


def curate(df: DataFrame, order: str, config: CurateConfig = CurateConfig()) -> DataFrame:
    """df's records with stage and reason, both null for accepted rows. order must be unique and not null.

    Texts are read once for a narrow work table of order value, errors, issues and content digest, from which all is
    decided; the decisions are joined back by order, so texts are redacted a second time only if the caller takes them.
    """
    if config.dedup_method not in ("exact", "near", "off"):
        raise ValueError(f"unknown dedup method: {config.dedup_method}")
    rows = records.to_records(df, order)
    errors = records.validation_errors(records.record_format(df.columns))
    checked = rows.withColumn("_errors", F.array_join(errors, "; ") if config.validate else F.lit(""))
    if config.redact_pii:
        rows, checked = redacted(rows), redacted(checked)
    narrow = rules.rule_issues(checked.select(F.col(order).alias("_ord"), "_errors", "prompt", "response", "content"))
    key = F.sha2(strip(F.col("content")), 256) if config.dedup_method == "exact" else F.lit(None).cast("string")
    narrow = cut(narrow.select("_ord", "_errors", "issues", key.alias("_key")), "curate")
    valid = narrow.where("_errors = ''")
    if config.dedup_method == "exact":
        first = valid.groupBy("_key").agg(F.min("_ord").alias("_ord")).select("_ord", F.lit(True).alias("_keep"))
        narrow = narrow.join(first, "_ord", "left").withColumn("_keep", F.col("_keep").isNotNull())
    elif config.dedup_method == "near":
        texts = cut(rows.select(F.col(order).alias("_ord"), "content").join(valid.select("_ord"), "_ord", "left_semi"), "curate-texts")
        kept = dedup.near_keep(texts, "_ord", "content", config.threshold).select(F.col("ord").alias("_ord"), F.col("keep").alias("_keep"))
        narrow = narrow.join(kept, "_ord", "left")
    else:
        narrow = narrow.withColumn("_keep", F.lit(True))
    bad, dup = F.col("_errors") != "", (F.col("_errors") == "") & ~F.col("_keep")
    narrow = rules.rule_scores(narrow)
    why = rules.rejection_reason(config.min_score)
    stage = F.when(bad, "validate").when(dup, "dedup").when(why.isNotNull(), "filter")
    reason = F.when(bad, F.col("_errors")).when(dup, F.lit(f"{config.dedup_method}_duplicate")).otherwise(why)
    decided = narrow.withColumns({"stage": stage, "reason": reason}).drop("_errors", "_key", "_keep")
    return rows.join(decided, rows[order] == decided["_ord"]).drop("_ord")


def rejection_counts(curated: DataFrame) -> DataFrame:
    return curated.where("stage is not null").groupBy(F.concat_ws(": ", "stage", "reason").alias("reason")).agg(F.count("*").alias("n"))
