"""The command line: python -m gristmill COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.work import cut
from .governance.access import AccessPolicy
from .governance.runs import AuditStore, RunRegistry
from .governance.sbom import sbom
from .operators import analysis, dedup, evaluation, gate, generate, metrics, records
from .plans import pipeline
from .providers.base import create_provider
from .report import html_report, markdown_report, summarise
from .sources import files


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return pipeline.prepare(pipeline.read_records(spark, path))


def _views(rows: DataFrame) -> DataFrame:
    return rows.select("_ord", "id", "fmt", F.col("prompt_text").alias("prompt"), F.col("response_text").alias("response"), "classify_text", "content")


def _scored(rows: DataFrame, provider) -> DataFrame:
    names = [*pipeline._SCORE_NAMES, "rule_check_passed", "scoring_error"]
    return rows.drop(*names).join(generate.audit(_views(rows), "_ord", provider), "_ord")


def _split(kept: DataFrame, target: str) -> dict:
    """Write rows with column keep: those that stay to target, the others beside it."""
    kept = cut(kept, "split")
    files.write_dataset(pipeline.as_output(kept.where("keep").drop("stage", "reason")), target)
    files.write_dataset(pipeline.as_output(kept.where("not keep")), f"{files.companion_stem(target)}.rejected.jsonl")
    one = kept.agg(F.count_if(F.col("keep")).alias("accepted"), F.count_if(~F.col("keep")).alias("rejected")).first()
    return one.asDict()


def _labelled(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).select("id", F.col("classify_text").alias("text"), F.when(F.col("label_kind") == "scalar", F.col("labels")[0]).alias("label"))


def score(spark, a):
    scored = _scored(_rows(spark, a.input), create_provider(a.provider))
    if a.filter:
        return _split(generate.quality_split(scored, a.min_score).withColumnRenamed("kept", "keep"), a.output)
    files.write_dataset(pipeline.as_output(scored.drop("stage", "reason")), a.output)
    return {"scored": scored.count()}


def refine(spark, a):
    rows = _rows(spark, a.input)
    new = generate.refine(_views(rows), "_ord", create_provider(a.provider), a.mode).select("_ord", F.col("prompt").alias("_p"), F.col("response").alias("_r"))
    out = records.update_content(rows.join(new, "_ord"), "_p", "_r").drop("_p", "_r", "stage", "reason")
    files.write_dataset(pipeline.as_output(out), a.output)
    return {"refined": out.count()}


def evolve(spark, a):
    out = generate.evolve(_views(_rows(spark, a.input)).drop("id"), "_ord", create_provider(a.provider))
    files.write_dataset(out, a.output)
    return {"evolved": out.count()}


def dpo(spark, a):
    out = generate.preference_pairs(_views(_rows(spark, a.input)).drop("_ord"), "id", create_provider(a.provider))
    files.write_dataset(out.select("id", "prompt", "chosen", "rejected"), a.output)
    return {"pairs": out.count()}


def dedup_(spark, a):
    rows = _rows(spark, a.input)
    if a.method == "exact":
        kept = dedup.exact_keep(rows, "_ord", "content")
    elif a.method in ("minhash", "near"):
        kept = rows.join(dedup.near_keep(rows, "_ord", "content", a.threshold).withColumnRenamed("ord", "_ord"), "_ord")
    else:
        vectors = generate.embed(rows.select("_ord", "content"), "content", pipeline.HashedNgrams())
        kept = rows.join(dedup.semantic_keep(cut(vectors), "_ord", "embedding", a.threshold).withColumnRenamed("ord", "_ord"), "_ord")
    return _split(kept, a.output)


def stats(spark, a):
    return summarise(_scored(_rows(spark, a.input), create_provider(a.provider)))


def report(spark, a):
    s = stats(spark, a)
    files.write_text(spark, a.output, markdown_report(s) if a.output.endswith(".md") else html_report(s, a.provider))
    return {"written": a.output}


def optimize(spark, a):
    names = {k: getattr(a, k) for k in ("quality_mode", "dedup_method", "classification", "accuracy_contract", "provider")}
    config = pipeline.PipelineConfig(**names, scrub_pii=not a.no_pii, report_html=a.report_html, metrics_text=a.metrics, requests_per_minute=a.per_minute or None)
    return pipeline.run_file(spark, a.input, a.output, config).report


def synthesize(spark, a):
    rows = _rows(spark, a.input)
    out = generate.synthesize(rows.select("id", "content"), "id", "content", create_provider(a.provider), a.pairs)
    files.write_dataset(out.drop("k"), a.output)
    return {"pairs": out.count()}


def export(spark, a):
    chats = _rows(spark, a.input)
    both = chats.where("prompt_text <> '' and response_text <> ''")
    side = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    files.write_dataset(both.select("id", F.array(side("human", "prompt_text"), side("gpt", "response_text")).alias("conversations")), a.output)
    return {"records": both.count()}


def scrub(spark, a):
    config = pipeline.PipelineConfig(quality_mode="off", dedup_method="off", classification="off", classification_pii_mode=a.mode)
    state = {"metrics": {"stages": {}}}
    out = cut(pipeline.Run(config).pii(_rows(spark, a.input), state), "scrub")
    files.write_dataset(pipeline.as_output(out.drop("stage", "reason")), a.output)
    return state["metrics"]["stages"]["pii"] | {"redacted_records": out.where("redactions > 0").count()}


def validate(spark, a):
    """Summary and the first ten errors with their row numbers."""
    rows = analysis.positions(_rows(spark, a.input).select("_ord", F.array_join(records.row_errors(), "; ").alias("e")), "_ord", "row")
    bad = rows.where("e <> ''")
    return {"rows": rows.count(), "invalid": bad.count(), "first": [f"Row {r['row']}: {r['e']}" for r in bad.orderBy("row").limit(10).collect()]}


def filter_ppl(spark, a):
    rows = _rows(spark, a.input)
    text = F.coalesce(*(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("output", "text", "instruction")), F.lit(""))
    return _split(metrics.perplexity_filter(rows.withColumn("_t", text), "_ord", "_t", a.max_ppl).withColumnRenamed("kept", "keep"), a.output)


def classify(spark, a):
    rows = _rows(spark, a.input)
    provider = create_provider(a.provider)
    schema = generate.resolve_schema(provider, a.mode, a.classes.split(",") if a.classes else None, lambda: pipeline.sample_texts(rows, 100))
    if not schema["applicable"]:
        return schema
    found = generate.classify(rows, "_ord", "classify_text", provider, schema["task_type"], schema["classes"]).withColumnsRenamed({"labels": "_l", "item_confidence": "_c"})
    out = rows.drop("labels", "label_kind").join(found, "_ord").withColumn("keep", F.col("classification_error").isNull())
    kind = "list" if schema["task_type"] == "multi-label" else "scalar"
    return _split(out.withColumns({"labels": F.col("_l"), "label_kind": F.when(F.col("keep"), kind).otherwise("none")}), a.output) | {"schema": schema}


def augment(spark, a):
    out = generate.augment(_labelled(spark, a.input), "id", "text", "label", create_provider(a.provider), a.multiplier)
    files.write_dataset(out, a.output)
    return out.agg(F.count("*").alias("records"), F.count_if(F.col("is_synthetic")).alias("synthetic")).first().asDict()


def generate_(spark, a):
    pool, found = gate.gated_generation(_labelled(spark, a.input), _labelled(spark, a.validation), "id", "text", "label", create_provider(a.provider), a.min_gain, a.iterations)
    files.write_dataset(pool, a.output)
    return found


def shard(spark, a):
    rows = files.read_dataset(spark, a.input, number="_gm_order")
    label = next((k for k in records.LABEL_KEYS if k in rows.columns), None)
    return {"partitions": files.partition_files(rows, a.output, a.n, None if a.plain else label, "_gm_order")}


def merge(spark, a):
    return files.merge_files(spark, a.inputs, a.output)


def contract(spark, a):
    import yaml

    requirements = (yaml.safe_load(files.read_text(spark, a.contract)) or {}).get("requirements", {})
    broken = evaluation.contract_violations(json.loads(files.read_text(spark, a.report)), requirements)
    return {"passed": not broken, "violations": broken}


def audit(spark, a):
    store = AuditStore(spark, a.store)
    if a.action == "record":
        return {"run_id": store.record(**dict(x.split("=", 1) for x in a.values))}
    rows = store.usage() if a.action == "usage" else store.query(limit=a.limit, **dict(x.split("=", 1) for x in a.values))
    return [r.asDict() for r in rows.limit(1000).collect()]


def runs(spark, a):
    registry = RunRegistry(spark, a.store)
    if a.action == "submit":
        return {"run_id": registry.submit(a.target, json.loads(a.spec))}
    if a.action == "list":
        return [r.asDict() for r in registry.latest(a.target).collect()]
    if a.action == "lineage":
        return [r.asDict() for r in registry.lineage(a.target).orderBy("depth").collect()]
    if a.action == "verify":
        return registry.verify(a.target)
    if a.action == "resume":
        return {"run_id": registry.resume(a.target)}
    if a.action == "cancel":
        registry.move(a.target, "cancelled")
    return registry.get(a.target).asDict()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill", description="Datasets for training: read, clean, judge, extend, split and report.")
    p.add_argument("--policy", help="a YAML access policy; the actor then needs the permission run:COMMAND")
    p.add_argument("--actor", default="")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *places, **options):
        c = sub.add_parser(name, help=f.__doc__)
        c.set_defaults(f=f)
        for x in places:
            c.add_argument(x)
        for k, v in options.items():
            flag = f"--{k.replace('_', '-')}"
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, default=v, type=type(v) if v is not None else str)
        return c

    io = ("input", "output")
    add("score", score, *io, provider="offline", filter=False, min_score=7.0)
    add("refine", refine, *io, provider="offline", mode="all")
    add("evolve", evolve, *io, provider="offline")
    add("dpo", dpo, *io, provider="offline")
    add("dedup", dedup_, *io, method="exact", threshold=0.85)
    add("stats", stats, "input", provider="offline")
    add("report", report, *io, provider="offline")
    for name in ("optimize", "pipeline"):
        add(name, optimize, *io, provider="offline", quality_mode="llm", dedup_method="auto", classification="auto", accuracy_contract="balanced", no_pii=False, report_html=False, metrics=False, per_minute=0)
    add("synthesize", synthesize, *io, provider="offline", pairs=10)
    add("export", export, *io)
    add("scrub", scrub, *io, mode="all")
    add("validate", validate, "input")
    add("filter-ppl", filter_ppl, *io, max_ppl=1000.0)
    add("classify", classify, *io, provider="offline", mode="auto", classes="")
    add("augment", augment, *io, provider="offline", multiplier=1)
    add("generate", generate_, "input", "validation", "output", provider="offline", min_gain=0.1, iterations=5)
    add("shard", shard, *io, n=8, plain=False)
    add("merge", merge, "output").add_argument("inputs", nargs="+")
    add("contract", contract, "contract", "report")
    add("audit", audit, "action", "store", limit=100).add_argument("values", nargs="*")
    add("runs", runs, "action", "store", "target", spec="{}")
    add("sbom", lambda spark, a: sbom())
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; its result is printed as JSON. 1 if a contract is broken."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gristmill").getOrCreate()
    if a.policy:
        AccessPolicy.from_yaml(files.read_text(spark, a.policy)).check(a.actor, f"run:{a.command}")
    out = a.f(spark, a)
    print(json.dumps(out, indent=2, default=str, ensure_ascii=False))
    return int(isinstance(out, dict) and out.get("passed") is False)


if __name__ == "__main__":
    sys.exit(main())
