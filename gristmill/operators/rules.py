"""Heuristic rules, the scores that failures get, and the quality filter with its quarantine."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import strip, two_places

#: Marks of corrupted or unfinished records.
BAD = ["�", "<|im_end|>", "<|im_start|>", "<|endoftext|>", "[TODO:", "[insert code here]", "lorem ipsum"]


@F.pandas_udf(DoubleType())
def repeat_ratio(texts: pd.Series) -> pd.Series:
    """Share of word 3-grams that occurred before in the text; null for 30 words or fewer. As a native higher-order function this is re-evaluated per word."""

    def one(text):
        w = (text or "").split()
        return 1.0 - len(set(zip(w, w[1:], w[2:]))) / (len(w) - 2) if len(w) > 30 else None

    return texts.map(one).astype("float64")


def rule_issues(df: DataFrame, prompt: str = "prompt", response: str = "response", lengths: tuple[int, int, int, int] = (4, 15000, 5, 50000), repeat: float = 0.35) -> DataFrame:
    """df with issues (array of strings). An empty prompt takes the response's place.

    A text that is both is looked through once, and for each mark only if it has one of their beginnings.
    """
    low_p, high_p, low_r, high_r = lengths
    alone = F.col(prompt) == ""
    p = F.when(alone, F.col(response)).otherwise(F.col(prompt))
    starts = sorted({b[:2] if b.startswith("<|") else b for b in BAD})
    some = lambda c: reduce(or_, (F.contains(F.col(c), F.lit(x)) for x in starts))
    df = df.withColumns({"_p": p, "_r": F.col(response), "_ratio": repeat_ratio(F.col(response)), "_marked": some(response) | (~alone & some(prompt))})
    ratio = F.col("_ratio")
    checks = [
        F.when(F.char_length(strip(F.col("_p"))) < low_p, F.lit(f"Prompt too short (< {low_p} chars)")),
        F.when(F.char_length("_p") > high_p, F.format_string(f"Prompt exceeds max length (%d > {high_p})", F.char_length("_p"))),
        F.when(F.char_length(strip(F.col("_r"))) < low_r, F.lit(f"Response too short (< {low_r} chars)")),
        F.when(F.char_length("_r") > high_r, F.format_string(f"Response exceeds max length (%d > {high_r})", F.char_length("_r"))),
        *(F.when(F.col("_marked") & (F.contains(F.col("_p"), F.lit(b)) | F.contains(F.col("_r"), F.lit(b))), F.lit(f"Contains corrupted token/placeholder: {b}")) for b in BAD),
        F.when(ratio > repeat, F.concat(F.lit("Degenerate repetition loop detected (repeat ratio: "), two_places(ratio), F.lit(")"))),
    ]
    return df.withColumn("issues", F.filter(F.array(*checks), lambda e: e.isNotNull())).drop("_p", "_r", "_ratio", "_marked")


#: The scores of a record that fails the rules.
FAILED = {"overall_score": 2.0, "clarity": 3.0, "factual_accuracy": 3.0, "reasoning_depth": 1.0, "instruction_following": 2.0}


def rule_scores(df: DataFrame, passed: float = 8.0) -> DataFrame:
    """df with the five scores: fixed ones for failures, `passed` from the offline scorer else."""
    ok = F.size("issues") == 0
    return df.withColumns({k: F.when(ok, F.lit(passed)).otherwise(F.lit(v)) for k, v in FAILED.items()} | {"is_safe": F.lit(True)})


def rejection_reason(least: float) -> Column:
    """Why the quality filter rejects a record; null if it doesn't."""
    low = F.concat(F.lit("quality score "), two_places(F.col("overall_score")), F.lit(f" below {least:.2f}"))
    return F.when(F.col("overall_score").isNull(), F.lit("no quality score")).when(~F.col("is_safe"), F.lit("unsafe")).when(F.col("overall_score") < least, low)


def score_stats(df: DataFrame) -> DataFrame:
    zero = lambda c, name: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(name)
    o = F.col("overall_score")
    return df.agg(F.count("*").alias("total_items"), F.count(o).alias("scored_items"), zero(F.avg(o), "mean_score"), zero(F.median(o), "median_score"), zero(F.min(o), "min_score"), zero(F.max(o), "max_score"), zero(F.stddev_pop(o), "std_score"))


def top_issues(df: DataFrame, order: str, n: int = 8) -> DataFrame:
    """The n most frequent issues; of equally frequent ones the first seen."""
    rows = df.select(F.col(order).alias("at"), F.posexplode("issues").alias("k", "issue"))
    counts = rows.groupBy("issue").agg(F.count("*").alias("n"), F.min(F.struct("at", "k")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(n).select("issue", "n")
