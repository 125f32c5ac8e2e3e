"""Audit reports about scored records: one aggregate in Spark, rendered on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The dimensions of a score and how they are called.
DIMENSIONS = {"clarity": "Clarity", "factual_accuracy": "Factual accuracy", "reasoning_depth": "Reasoning depth", "instruction_following": "Instruction following"}


def summarise(scored: DataFrame, order: str = "_ord", issues: int = 8) -> dict:
    """Counts, spread of the overall score, means of its dimensions, and the most frequent issues; zeros without scores."""
    o = F.col("overall_score")
    spread = {"mean": F.avg(o), "median": F.median(o), "min": F.min(o), "max": F.max(o), "std": F.stddev_pop(o)}
    one = scored.agg(F.count("*").alias("total_items"), F.count(o).alias("scored_items"), *(F.coalesce(c, F.lit(0.0)).alias(f"{k}_score") for k, c in spread.items()), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in DIMENSIONS)).first().asDict()
    rows = scored.where("issues is not null").select(F.col(order).alias("at"), F.posexplode("issues").alias("k", "issue"))
    top = rows.groupBy("issue").agg(F.count("*").alias("n"), F.min(F.struct("at", "k")).alias("first")).orderBy(F.desc("n"), "first").limit(issues)
    return one | {"top_issues": [(r["issue"], r["n"]) for r in top.collect()]}


def _facts(s: dict) -> list[tuple[str, str]]:
    out = [("Records", str(s["total_items"])), ("Scored records", str(s["scored_items"])), ("Mean score", f"{s['mean_score']:.2f}"), ("Median score", f"{s['median_score']:.2f}"), ("Score range", f"{s['min_score']:.2f} to {s['max_score']:.2f}"), ("Standard deviation", f"{s['std_score']:.2f}")]
    return out + [(f"Mean {name.lower()}", f"{s[f'mean_{c}']:.2f}") for c, name in DIMENSIONS.items()]


def markdown_report(s: dict) -> str:
    lines = ["# Audit report", "", "| Measure | Value |", "|-|-|", *(f"| {k} | {v} |" for k, v in _facts(s)), "", "## Most frequent issues", ""]
    return "\n".join(lines + ([f"* {i}: {n}" for i, n in s["top_issues"]] or ["None."])) + "\n"


def html_report(s: dict, provider: str = "") -> str:
    cells = "".join(f"<tr><td>{escape(k)}</td><td>{escape(v)}</td></tr>" for k, v in _facts(s))
    items = "".join(f"<li>{escape(i)}: {n}</li>" for i, n in s["top_issues"]) or "<li>None.</li>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Audit report</title></head><body><h1>Audit report</h1><p>{escape(provider, quote=True)}</p><table>{cells}</table><h2>Most frequent issues</h2><ul>{items}</ul></body></html>\n"


def metrics_text(metrics: dict) -> str:
    """A run's counts and times in the text format that metric collectors read from files."""
    lines = ["# TYPE gristmill_stage_seconds gauge", "# TYPE gristmill_stage_records gauge"]
    for name, m in metrics["stages"].items():
        lines.append(f'gristmill_stage_seconds{{stage="{name}"}} {m.get("seconds", 0)}')
        lines += [f'gristmill_stage_records{{stage="{name}",outcome="{k}"}} {m.get(k, 0)}' for k in ("accepted", "rejected")]
    for k, v in metrics.get("usage", {}).items():
        lines.append(f'gristmill_tokens{{kind="{k}",provider="{metrics.get("provider", "")}"}} {v}')
    return "\n".join(lines) + "\n"
