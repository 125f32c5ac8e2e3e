"""Predictions by a naive Bayes teacher, agreement of labels, costs of runs, merged reports, data contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_']+)"))


def nb_predict(train: DataFrame, rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, predicted, confidence (posterior) of each row, by a multinomial model with add-one smoothing.

    Tokens never seen in a class count there with one over its denominator. Rows of train without a label or without a
    token are skipped; rows without a token get the most frequent class; of equal scores the smallest label wins; with
    fewer than two classes every prediction is null with confidence 0.
    Rows of one key are one text: key must be unique for a prediction per row; a null key is one as well.
    The sum over all tokens is split: seen tokens are joined, what unseen ones add follows from the number of tokens.
    """
    known = train.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), _tokens(text).alias("t")).where("size(t) > 0")
    classes = known.groupBy("label").agg(F.count("*").alias("docs"), F.sum(F.size("t")).alias("total"))
    if classes.limit(2).count() < 2:
        return rows.select(key, F.lit(None).cast("string").alias("predicted"), F.lit(0.0).alias("confidence"))
    counts = known.select("label", F.explode("t").alias("token")).groupBy("label", "token").agg(F.count("*").alias("c"))
    whole = classes.agg(F.collect_list(F.struct("label", "docs", "total")).alias("classes"), F.sum("docs").alias("all")).join(counts.agg(F.count_distinct("token").alias("v")))
    head = lambda c: F.struct(c["label"].alias("label"), F.log(c["docs"] / F.col("all")).alias("prior"), F.log((c["total"] + F.col("v")).cast("double")).alias("denominator"))
    heads = whole.select(F.transform("classes", head).alias("heads"))  # one row; every text is scored for every class
    texts = rows.select(F.col(key), _tokens(text).alias("t"))
    base = texts.join(F.broadcast(heads)).select(key, F.size("t").alias("n"), F.explode("heads").alias("h")).select(key, "h.label", (F.col("h.prior") - F.col("n") * F.col("h.denominator")).alias("s"))
    words = texts.select(key, F.explode("t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    seen = words.join(counts, "token").select(key, "label", (F.col("n") * F.log(F.col("c") + 1)).alias("s"))
    scores = base.unionByName(seen).groupBy(key, "label").agg(F.sum("s").alias("s"))
    best = F.array_max(F.collect_list(F.col("s")))
    found = scores.groupBy(key).agg(best.alias("peak"), F.collect_list(F.struct("s", "label")).alias("all"))
    at_peak = F.transform(F.filter("all", lambda x: x["s"] == F.col("peak")), lambda x: x["label"])
    odds = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("peak")))
    return found.select(key, F.array_min(at_peak).alias("predicted"), (1 / odds).alias("confidence"))


def class_agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn, f1 of every class that either column has; rows with a null on one side count for the other."""
    both = df.select(F.col(actual).alias("a"), F.col(predicted).alias("p"))
    each = both.select("a", "p", F.explode(F.array_compact(F.array_distinct(F.array("a", "p")))).alias("label"))
    hit_a, hit_p = F.col("a").eqNullSafe(F.col("label")), F.col("p").eqNullSafe(F.col("label"))
    counts = each.groupBy("label").agg(F.count_if(hit_a & hit_p).alias("tp"), F.count_if(~hit_a & hit_p).alias("fp"), F.count_if(hit_a & ~hit_p).alias("fn"))
    return counts.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: macro_f1, accuracy; 0 without rows."""
    f1 = class_agreement(df, actual, predicted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    right = df.agg(F.coalesce(F.avg(F.col(actual).eqNullSafe(F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))
    return f1.join(right)


def diagnose(df: DataFrame, actual: str, predicted: str, order: str, k: int) -> DataFrame:
    """label, n, accuracy and the first k rows (by order) that were misclassified, as a list of order values.

    Only wrong rows are ranked; the ranking stops at k per label, which Spark pushes below its shuffle.
    """
    right = F.col(actual).eqNullSafe(F.col(predicted))
    rates = df.groupBy(F.col(actual).alias("label")).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    rank = F.row_number().over(Window.partitionBy(actual).orderBy(order))
    wrong = df.where(~right).withColumn("_k", rank).where(F.col("_k") <= k)
    examples = wrong.groupBy(F.col(actual).alias("_label")).agg(F.array_sort(F.collect_list(order)).alias("examples"))
    return rates.join(examples, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def cost_estimate(runs: DataFrame, pricing: dict[str, dict[str, float]], provider: str, input_tokens: str, output_tokens: str) -> DataFrame:
    """provider, cost_usd, unpriced_tokens; a provider without an entry in pricing has no cost, only unpriced tokens."""
    rate = {}
    for side in ("input_per_1k", "output_per_1k"):
        pairs = [F.lit(x) for k, v in pricing.items() if v for x in (k, float(v.get(side, 0.0)))]
        rate[side] = F.create_map(*pairs)[F.col(provider)] if pairs else F.lit(None).cast("double")
    cost = F.col(input_tokens) / 1000 * rate["input_per_1k"] + F.col(output_tokens) / 1000 * rate["output_per_1k"]
    unpriced = F.when(rate["input_per_1k"].isNull(), F.col(input_tokens) + F.col(output_tokens)).otherwise(0)
    return runs.groupBy(F.col(provider).alias("provider")).agg(F.sum(cost).alias("cost_usd"), F.sum(unpriced).alias("unpriced_tokens"))


def merge_reports(reports: list[DataFrame], keys: list[str], amount: str) -> DataFrame:
    """Counts of several partitions' reports, added up by key."""
    merged = reports[0]
    for r in reports[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    return merged.groupBy(*keys).agg(F.sum(amount).alias(amount))


@dataclass(frozen=True)
class Requirement:
    """One line of a data contract: where the evidence is, when it suffices, and how both are shown."""

    evidence: Callable[[dict], object]
    holds: Callable[[object, object], bool]
    wanted: Callable[[object], str]
    found: Callable[[object, object], str]


def _part(report: dict, *path: str):
    for p in path:
        report = (report or {}).get(p)
    return report


def _relative_gain(report: dict) -> float | None:
    gate = _part(report, "metrics", "accuracy_gate") or {}
    base = gate.get("original_accuracy_mean", gate.get("baseline_accuracy"))
    absolute = gate.get("accuracy_gain")
    return gate["relative_gain"] if gate.get("relative_gain") is not None else absolute / base if base and absolute is not None else None


def rejected_fraction(report: dict) -> float:
    """Rejected records of all; 0 if there are none."""
    gone, kept = (_part(report, "metrics", k) or 0 for k in ("rejected_records", "accepted_records"))
    return gone / (gone + kept) if gone + kept else 0.0


_AT_LEAST, _EQUAL = (lambda have, want: have is not None and have >= want), (lambda have, want: have == want)
CONTRACT = {
    "min_relative_accuracy_gain": Requirement(_relative_gain, _AT_LEAST, lambda w: f">= {w:.1%}", lambda h, w: "no evidence" if h is None else f"{h:+.1%}"),
    "min_quality_score": Requirement(lambda r: _part(r, "metrics", "stages", "score_refine", "average_overall_score"), _AT_LEAST, lambda w: f">= {w:.2f}", lambda h, w: "unavailable" if h is None else f"{h:.2f}"),
    "max_rejected_fraction": Requirement(rejected_fraction, lambda have, want: have <= want, lambda w: f"<= {w:.1%}", lambda h, w: f"{h:.1%}"),
    "required_pii_policy": Requirement(lambda r: _part(r, "metrics", "stages", "pii", "policy"), _EQUAL, str, lambda h, w: str(h)),
    "required_network_policy": Requirement(lambda r: _part(r, "metrics", "network_policy"), _EQUAL, str, lambda h, w: str(h)),
    "required_classes": Requirement(lambda r: set(_part(r, "profile", "classes") or ()), lambda have, want: set(want) <= have, lambda w: f"includes {sorted(w)}", lambda h, w: f"missing {sorted(set(w) - h)}"),
}


def contract_violations(report: dict, requirements: dict) -> list[dict]:
    """What a finished run's report breaks: requirement, expected, actual. Requirements that are absent or None
    hold; evidence that is absent doesn't; a name that is not known ends the check."""
    if unknown := set(requirements) - set(CONTRACT):
        raise ValueError(f"unknown requirements: {sorted(unknown)}")
    out = []
    for name, rule in CONTRACT.items():
        want = requirements.get(name)
        have = rule.evidence(report)
        if want is not None and not rule.holds(have, want):
            out.append({"requirement": name, "expected": rule.wanted(want), "actual": rule.found(have, want)})
    return out
