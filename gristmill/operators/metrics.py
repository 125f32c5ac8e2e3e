"""Measures: answers against references, bigram models and perplexity, what a run did to rows of each kind, runs compared."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.work import cut
from . import vectors


#: Pairs of a bigram model that is sent to all tasks, at most.
BROADCAST = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_']+)"))


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence by bit vectors over a."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    free = full = (1 << len(a)) - 1
    for y in b:
        hit = free & at.get(y, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def answer_scores(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """df with exact_match, token_f1 (shared tokens as often as both have them) and rouge_l (longest common subsequence), 0 to 1.

    Tokens are lower-case runs of letters, digits, _ and '. Two texts without tokens agree fully.
    """

    @F.pandas_udf("double")
    def rouge(p: pd.Series, e: pd.Series) -> pd.Series:
        def one(a, b):
            a, b = list(a), list(b)
            if not a or not b:
                return float(not a and not b)
            return 2 * _lcs(a, b) / (len(a) + len(b))

        return pd.Series([one(a, b) for a, b in zip(p, e)], dtype="float64")

    rows = df.withColumns({"_p": tokens(F.col(predicted)), "_e": tokens(F.col(expected))})

    @F.pandas_udf("double")
    def f1(p: pd.Series, e: pd.Series) -> pd.Series:
        def one(a, b):
            x, y = Counter(a), Counter(b)
            if not x and not y:
                return 1.0
            return 2 * sum((x & y).values()) / (len(a) + len(b))

        return pd.Series([one(a, b) for a, b in zip(p, e)], dtype="float64")

    return rows.withColumns({"exact_match": (F.array_join("_p", " ") == F.array_join("_e", " ")).cast("double"), "token_f1": f1("_p", "_e"), "rouge_l": rouge("_p", "_e")}).drop("_p", "_e")


def _pairs(df: DataFrame, *keep: str) -> DataFrame:
    """a, b: neighbouring tokens of each text in column t."""
    zipped = F.explode(F.arrays_zip(F.expr("slice(t, 1, greatest(size(t) - 1, 0))").alias("a"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("b")))
    return df.select(*keep, zipped.alias("p")).select(*keep, F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def bigram_model(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(a, b, n), (a, total, best): counts of token pairs, those of contexts with the most frequent next token, and the
    number of different tokens. Of equally frequent next tokens the first by code points is best."""
    rows = df.select(tokens(F.col(text)).alias("t"))
    pairs = cut(_pairs(rows).groupBy("a", "b").agg(F.count("*").alias("n")), "bigrams")
    best = F.min(F.struct((-F.col("n")).alias("m"), "b"))["b"]
    contexts = pairs.groupBy("a").agg(F.sum("n").alias("total"), best.alias("best"))
    words = rows.select(F.explode("t").alias("w")).agg(F.count_distinct("w").alias("v")).first()["v"]
    return pairs, contexts, max(words, 1)


def _transitions(df: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame, int], alpha: float) -> DataFrame:
    """key, right, nll, n per pair of a text: n times the pair's negative log probability, how often it is the best one.

    Pairs meet a small model where the texts lie, each occurrence for itself, and only sums of texts are shuffled. A
    large one meets the different pairs of each text, which are counted first.
    """
    pairs, contexts, words = model
    rows = _pairs(df.select(key, tokens(F.col(text)).alias("t")), key)
    small = pairs.count() <= BROADCAST
    here = rows.withColumn("k", F.lit(1).cast("long")) if small else rows.groupBy(key, "a", "b").agg(F.count("*").alias("k"))
    near = F.broadcast if small else lambda x: x
    seen = here.join(near(pairs), ["a", "b"], "left").join(near(contexts), "a", "left")
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + alpha * words)
    return seen.select(key, F.when(F.col("b").eqNullSafe(F.col("best")), F.col("k")).otherwise(0).alias("right"), (-F.log(p) * F.col("k")).alias("nll"), F.col("k").alias("n"))


def language_model(train: DataFrame, held: DataFrame, key: str, text: str, alpha: float = 0.1) -> DataFrame:
    """One row: eval_transitions, next_token_accuracy, perplexity of held texts under the bigram model of train; 0 and null without pairs."""
    steps = _transitions(held, key, text, bigram_model(train, text), alpha)
    one = steps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"), F.sum("nll").alias("nll"))
    share = F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0)
    return one.select(F.col("n").alias("eval_transitions"), share.alias("next_token_accuracy"), F.exp(F.col("nll") / F.col("n")).alias("perplexity"))


def perplexity(df: DataFrame, key: str, text: str, train: DataFrame | None = None, alpha: float = 0.1) -> DataFrame:
    """key, perplexity of each text under the bigram model of train (df itself if not given); infinite for texts of fewer than two tokens."""
    steps = _transitions(df, key, text, bigram_model(df if train is None else train, text), alpha)
    each = steps.groupBy(key).agg(F.exp(F.sum("nll") / F.sum("n")).alias("perplexity"))
    return df.select(key).join(each, key, "left").select(key, F.coalesce("perplexity", F.lit(math.inf)).alias("perplexity"))


def perplexity_filter(df: DataFrame, key: str, text: str, most: float, train: DataFrame | None = None) -> DataFrame:
    """df with perplexity (infinite for fewer than two tokens) and kept: it is `most` or less. Rows are scored each on their own, whatever their keys."""
    rows = cut(df.withColumn("_gm_row", F.monotonically_increasing_id()), "perplexity")
    found = perplexity(rows, "_gm_row", text, train).withColumnsRenamed({"_gm_row": "_gm_r", "perplexity": "_gm_p"})
    out = rows.join(found, rows["_gm_row"] == found["_gm_r"])
    return out.select(*(rows[c] for c in df.columns if c != "perplexity"), F.col("_gm_p").alias("perplexity"), (F.col("_gm_p") <= most).alias("kept"))


def defect_breakdown(outcome: DataFrame, category: str, stage: str) -> DataFrame:
    """category, input, retained, lost, lost_by_stage (stage to rows): rows whose stage is null were retained; no category is 'untagged'."""
    rows = outcome.select(F.coalesce(F.col(category), F.lit("untagged")).alias("category"), F.col(stage).alias("stage"))
    each = rows.groupBy("category", "stage").agg(F.count("*").alias("n"))
    lost = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("stage", "n")))))
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("category").agg(F.sum("n").alias("input"), zero(F.col("stage").isNull()).alias("retained"), zero(F.col("stage").isNotNull()).alias("lost"), lost.alias("lost_by_stage"))


def hygiene_summary(outcome: DataFrame, content: str, label: str, stage: str, reason: str) -> DataFrame:
    """One row about a run's outcome (all input rows, with the stage and reason of rejected ones): rows kept and deleted, in
    all and by stage and reason, duplicate groups and rows, groups and rows with conflicting labels (a copy whose label is not
    that of the group's most frequent one), rows without text."""
    key = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    rows = outcome.select(key.alias("k"), F.col(label).cast("string").alias("label"), (F.coalesce(F.col(content), F.lit("")) == "").alias("empty"), F.col(stage).alias("stage"), F.col(reason).alias("reason"))
    by_label = rows.groupBy("k", "label").agg(F.count("*").alias("n"), F.max("empty").alias("empty"))
    groups = by_label.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("n").alias("top"), F.max("empty").alias("empty"))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    n, split = F.col("n"), (F.col("labels") > 1)
    shape = groups.agg(F.count("*").alias("unique_content_rows"), total(n > 1, F.lit(1)).alias("duplicate_groups"), total(n > 1, n - 1).alias("duplicate_rows"), total(split, F.lit(1)).alias("conflicting_groups"), total(split, n - F.col("top")).alias("conflicting_rows"), total(F.col("empty"), n).alias("empty_rows"))
    fate = rows.groupBy("stage", "reason").agg(F.count("*").alias("n"))
    gone = F.col("stage").isNotNull()
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(c)))
    counts = fate.agg(F.sum("n").alias("input_rows"), total(~gone, n).alias("retained_rows"), total(gone, n).alias("deleted_rows"), as_map(F.when(gone, F.struct(F.concat_ws(": ", "stage", "reason"), "n"))).alias("deleted_by_reason"))
    stages = fate.where(gone).groupBy("stage").agg(F.sum("n").alias("n")).agg(as_map(F.struct("stage", "n")).alias("deleted_by_stage"))
    out = shape.join(counts).join(stages)
    return out.withColumn("deletion_rate", F.when(F.col("input_rows") > 0, F.col("deleted_rows") / F.col("input_rows")).otherwise(0.0))


def recovery_accuracy(ids: DataFrame, key: str, clean: DataFrame, actual: DataFrame, signature: str) -> DataFrame:
    """One row of keep/delete decisions on ids against a clean control run: deletion is the positive class.

    clean and actual have key and signature of the rows each run kept, keys once. Precision and recall are 1 where nothing
    was (to be) deleted.
    """
    c = clean.select(key, F.lit(True).alias("_c"))
    a = actual.select(key, F.lit(True).alias("_a"))
    both = ids.select(key).join(c, key, "left").join(a, key, "left").select(F.col("_c").isNotNull().alias("want"), F.col("_a").isNotNull().alias("have"))
    n = both.agg(F.count_if(~F.col("want") & ~F.col("have")).alias("tp"), F.count_if(F.col("want") & ~F.col("have")).alias("fp"), F.count_if(~F.col("want") & F.col("have")).alias("fn"), F.count_if(F.col("want") & F.col("have")).alias("tn"))
    same = clean.select(key, F.col(signature).alias("_s")).join(actual.select(key, F.col(signature).alias("_t")), key, "left")
    m = same.agg(F.count_if(F.col("_s").eqNullSafe(F.col("_t"))).alias("content_matches"), F.count("*").alias("content_expected"))
    ratio = lambda x, y, none: F.when(y > 0, x / y).otherwise(none)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return n.join(m).withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, 1.0),
        "deletion_precision": ratio(tp, tp + fp, 1.0),
        "deletion_recall": ratio(tp, tp + fn, 1.0),
        "deletion_f1": F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).when(fp + fn > 0, 0.0).otherwise(1.0),
        "content_accuracy": ratio(F.col("content_matches"), F.col("content_expected"), 1.0),
    })


def preservation(source: DataFrame, accepted: DataFrame, key: str, content: str) -> DataFrame:
    """One row about source rows in a run's output: kept, lost, changed, the share kept as it was, and characters before and after."""
    a = accepted.select(key, F.col(content).alias("_new"), F.lit(True).alias("_kept"))
    rows = source.select(key, F.col(content).alias("_old")).join(a, key, "left")
    kept, chars = F.col("_kept").isNotNull(), lambda c: F.coalesce(F.sum(F.char_length(c)), F.lit(0))
    one = rows.agg(F.count("*").alias("source_rows"), F.count_if(kept).alias("source_retained"), F.count_if(~kept).alias("source_lost"), F.count_if(kept & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("source_changed"), chars("_old").alias("characters_before"), chars("_new").alias("characters_after"))
    n, before = F.col("source_rows"), F.col("characters_before")
    return one.withColumns({"exact_preservation_rate": F.when(n > 0, (F.col("source_retained") - F.col("source_changed")) / n).otherwise(1.0), "character_retention": F.when(before > 0, F.col("characters_after") / before).otherwise(1.0)})


def run_spread(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), least and greatest value of repeated runs."""
    v = F.col(value)
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def multilabel_scores(df: DataFrame, actual: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """One row: macro_f1 over labels (all that occur, or those given), subset_accuracy (whole sets equal). Columns are arrays; null is an empty one."""
    none = F.array().cast("array<string>")
    rows = df.select(F.array_distinct(F.coalesce(F.col(actual), none)).alias("a"), F.array_distinct(F.coalesce(F.col(predicted), none)).alias("p"))
    each = rows.select("a", "p", F.explode(F.array_union("a", "p")).alias("label"))
    counts = each.groupBy("label").agg(F.count_if(F.array_contains("a", F.col("label")) & F.array_contains("p", F.col("label"))).alias("tp"), F.count("*").alias("any"))
    f1 = counts.select("label", (2 * F.col("tp") / (F.col("any") + F.col("tp"))).alias("f1"))
    if labels is not None:
        f1 = df.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(f1, "label", "left").select("label", F.coalesce("f1", F.lit(0.0)).alias("f1"))
    whole = rows.agg(F.coalesce(F.avg((F.array_sort("a") == F.array_sort("p")).cast("double")), F.lit(0.0)).alias("subset_accuracy"))
    return f1.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")).join(whole)


def nearest(train: DataFrame, queries: DataFrame, key: str, vector: str, probes: int = 64, **options) -> DataFrame:
    """query, nearest, sim: for each query vector the train row of the highest cosine, the smallest key of equal ones.

    Queries probe inverted lists of the train rows (see vectors; options are those of VectorIndex): the nearest of what they
    probe, or with exact=True of all. Vectors that are null, empty or without length have no nearest and are none;
    vectors meet those of their own length only.
    """
    some = lambda df, name: df.where(vectors.sound(vector)).select(F.col(key).alias(name), F.col(vector).alias("v"))
    rows, asked = cut(some(train, "ord"), "nearest-rows"), some(queries, "query")
    out = None
    for part in vectors.by_length(rows):
        size = F.size("v") == part.select(F.size("v").alias("d")).first()["d"]
        found = vectors.VectorIndex(part, probes, **options).nearest(asked.where(size))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.where(F.lit(False)).select("query", F.lit(None).cast(rows.schema["ord"].dataType).alias("nearest"), F.lit(None).cast("double").alias("sim"))
    return out


def normalise(df: DataFrame, kind: str) -> DataFrame:
    """Training records of a known kind in one form, without those that lack a part: alpaca, chat, dpo, qa, summarization, raw.

    Texts are stripped; a part that is empty then counts as missing.
    """
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c.split(".")[0] in df.columns else F.lit("")
    full = lambda *cs: F.expr(" and ".join(f"{c} <> ''" for c in cs))
    if kind == "alpaca":
        return df.select(text("instruction").alias("instruction"), text("input").alias("input"), text("output").alias("output")).where(full("instruction", "output"))
    if kind == "dpo":
        answer = lambda c: F.element_at(F.filter(c, lambda m: m["role"] == "assistant"), -1)["content"] if dict(df.dtypes).get(c, "").startswith("array") else F.col(c)
        rows = df.select(text("prompt").alias("prompt"), *(strip(F.coalesce(answer(c), F.lit(""))).alias(c) for c in ("chosen", "rejected")))
        return rows.where(full("prompt", "chosen", "rejected"))
    if kind == "qa":
        rows = df.select(text("question").alias("instruction"), text("context").alias("input"), strip(F.coalesce(F.get("answers.text", F.lit(0)), F.lit(""))).alias("output"))
        return rows.where(full("instruction", "input", "output"))
    if kind == "summarization":
        return df.select(F.lit("Summarize the following document.").alias("instruction"), text("document").alias("input"), text("summary").alias("output")).where(full("input", "output"))
    if kind == "raw":
        return df.select(text("text").alias("text")).where(full("text"))
    if kind != "chat":
        raise ValueError(f"unknown kind of record: {kind}")
    tidy = F.transform("messages", lambda m: F.struct(strip(F.coalesce(m["role"], F.lit(""))).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    rows = df.select(F.filter(tidy, lambda m: (m["role"] != "") & (m["content"] != "")).alias("messages"))
    has = lambda *roles: F.exists("messages", lambda m: m["role"].isin(*roles))
    return rows.where(has("user", "human") & has("assistant", "gpt", "model"))
