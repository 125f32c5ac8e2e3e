"""Quality rules with thresholds from quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, kind, lookup

SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none of them."""
    if not text:
        return 0, 0, 0, 0, 0
    found = text.encode().split()  # bytes split at \x20 and \x09-\x0D exactly
    n = len(found)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeats(found)


def _repeats(found: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(found)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, n)
    if (k := len(ids)) == n:
        return 0
    pair = number[:-1] * k + number[1:]
    if k >= 1 << 21:  # three numbers don't fit into 64 bits: number the pairs anew
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * k + number[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def _stats_batches(batches):
    for b in batches:
        stats = [text_stats(x) for x in b.column(b.num_columns - 1).to_pylist()]
        cols = list(zip(*stats)) if stats else [()] * 5
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


#: Measures with an upper fence, and the quantile up to which rows are taken to be usual.
UPPER = {"symbols": 0.9, "repeats": 0.95, "dup_lines": 0.98}
#: Measures with both fences.
BOTH = {"word_length": 0.9}
#: The least distance of a fence from its quartile, for groups whose usual rows are all alike.
ZERO = {"symbols": 0.15, "repeats": 0.25, "dup_lines": 2.0, "word_length": 0.5}


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n, "dup_lines": 100 * F.col("n_dup_lines") / n, "word_length": F.col("word_chars") / n}


def sketch(rows: DataFrame, keys: list[str], value: str, error: float) -> DataFrame:
    """A quantile sketch of value per keys: counts of logarithmic bins (bin long, n long); zero has a bin of its own.

    A value in a bin is within `error` of the bin's middle, relatively. Sketches merge by adding counts, in any order,
    to the same result.
    """
    gamma = (1 + error) / (1 - error)
    bins = F.when(F.col(value) <= 1e-6, F.lit(-(10**6))).otherwise(F.ceil(F.ln(F.col(value)) / float(np.log(gamma))))
    return rows.groupBy(*keys, bins.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float], error: float) -> DataFrame:
    """keys, n and the quantiles named in at. A window holds the bins of one sketch: some hundreds."""
    gamma = (1 + error) / (1 - error)
    by = Window.partitionBy(*keys)
    cum = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    middle = F.when(F.col("bin") == -(10**6), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bin")) / (gamma + 1))
    return cum.groupBy(*keys).agg(F.max("all").alias("n"), *(F.min(F.when(F.col("upto") >= F.col("all") * q, F.struct("bin", middle.alias("v"))))["v"].alias(k) for k, q in at.items()))


def quality_rules(docs: DataFrame, spread: float = 4.0, reach: float = 10.0, weight: int = 30, error: float = 0.01, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, the five base measures, base_failed, kept, group_weight, fence_<measure>, lang, source, key (a hash of the text).

    Base rules: fewer than 50 words, or over half the words in repeated 3-word windows. The others learn a fence per
    language and source from the rows that pass the base rules, from mergeable sketches: fence = third quartile of the
    group + the larger of spread * the distance of its quartiles and reach * the distance from the third quartile to a high
    quantile, the group's or its language's, whichever is less; for word length also below the first. Quartiles hold still
    while less than a quarter of a group is junk. A source full of junk doesn't widen its fence, as its language's quantile
    stays, nor do sources of another kind, as the group's own does. ZERO is the least of these distances, for groups
    whose usual rows are all alike, as without any symbol.
    Small groups lean on larger ones, without a step: a language's quantiles are drawn to those of all rows, and a
    group's to its language's, as if `weight` of its rows had those. group_weight says how much is the group's own, its
    rows / (its rows + weight); 0 if none of its rows passes the base rules.

    Null and empty texts have no words and fail. A null language or source is a group like any other. Very long texts are
    measured whole, one at a time. Columns other than the four named don't matter, whatever their names. Ids keep their
    type. Repeated rows each have a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    slim = slim.mapInArrow(_stats_batches, f"doc_id {kind(docs, id_col)}, lang string, source string, key long, {BASE}")
    slim = slim.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    slim = cut(slim.withColumns(measures()), "quality-measures")
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in measures())))
    values = slim.where("not base_failed").select("lang", "source", named.alias("m")).select("lang", "source", "m.*")
    base = cut(sketch(values, ["lang", "source", "measure"], "v", error), "quality-sketches")
    tails = sorted({*UPPER.values(), *BOTH.values()})
    at = {"low": 0.25, "high": 0.75} | {f"top{k}": q for k, q in enumerate(tails)}
    one = quantiles(base, ["lang", "source", "measure"], at, error)
    merged = base.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    two = quantiles(merged, ["lang", "measure"], at, error).select(F.col("lang").alias("lang2"), F.col("measure").alias("measure2"), *(F.col(c).alias(f"{c}2") for c in ("n", *at)))
    every = quantiles(merged.groupBy("measure", "bin").agg(F.sum("n").alias("n")), ["measure"], at, error).select(F.col("measure").alias("measure3"), *(F.col(c).alias(f"{c}3") for c in at))
    all_three = one.join(two, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2"))).join(F.broadcast(every), F.col("measure") == F.col("measure3"))
    drawn = lambda own, n, to: (F.col(n) * F.col(own) + weight * to) / (F.col(n) + weight)
    of_lang = {c: drawn(f"{c}2", "n2", F.col(f"{c}3")) for c in at}
    by_measure = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("measure"))
    at_top = lambda values: F.coalesce(*(F.when(by_measure(UPPER | BOTH) == q, values[f"top{k}"]) for k, q in enumerate(tails)))
    of_group = {c: drawn(c, "n", of_lang[c]) for c in at}
    usual = F.least(*(at_top(v) - v["high"] for v in (of_lang, of_group)))
    fences = all_three.select("lang", "source", "measure", "n", *(of_group[c].alias(c) for c in ("low", "high")), F.greatest(reach * usual, by_measure(ZERO)).alias("usual"))
    gap = F.greatest(spread * (F.col("high") - F.col("low")), F.col("usual"))
    fences = fences.groupBy("lang", "source").pivot("measure", list(UPPER | BOTH)).agg(F.first(F.struct((F.col("low") - gap).alias("low"), (F.col("high") + gap).alias("high"), "n")))
    fences = fences.select(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")).alias("group"), *(F.col(c).alias(f"fence_{c}") for c in UPPER | BOTH))
    rows = lookup(slim.withColumn("group", F.struct(F.col("lang").alias("l"), F.col("source").alias("s"))), cut(fences, "quality-fences"), "group", F.xxhash64("doc_id"))
    inside = F.lit(True)
    for c in UPPER | BOTH:
        inside = inside & (F.col(c) <= F.col(f"fence_{c}.high"))
    for c in BOTH:
        inside = inside & (F.col(c) >= F.col(f"fence_{c}.low"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.coalesce(F.col("fence_word_length.n") / (F.col("fence_word_length.n") + weight), F.lit(0.0)).alias("group_weight"), *(F.col(f"fence_{c}.high").alias(f"fence_{c}") for c in UPPER | BOTH), "lang", "source", "key")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that quality_rules keeps; columns as they are. Rows are told apart by id, language, source and a hash of the text, so repeated ids are judged row by row."""
    judged = quality_rules(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    gone = judged.where("not kept").select(*(F.col(c).alias(f"_gm_{c}") for c in ("doc_id", "lang", "source", "key"))).distinct()
    mine = {"_gm_doc_id": F.col(id_col), "_gm_lang": F.col(lang_col).cast("string"), "_gm_source": F.col(source_col).cast("string"), "_gm_key": F.xxhash64(text_col)}
    on = F.lit(True)
    for name, value in mine.items():
        on = on & value.eqNullSafe(gone[name])
    return docs.join(gone, on, "left_anti")
