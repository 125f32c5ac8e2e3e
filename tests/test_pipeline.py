"""The whole run: stages, contracts, plugins, resuming and companions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import plugins
from gristmill.functions import text as textf
from gristmill.functions.text import two_places
from gristmill.operators import evaluation, records, rules
from gristmill.plans.curate import CurateConfig, curate
from gristmill.plans.pipeline import PipelineConfig, Run, prepare, profile_records, run_file
from gristmill.providers.offline import OfflineProvider
from gristmill.sources import files

LONG = " ".join(f"word{k}" for k in range(60))


def rows_of(spark, dicts):
    found = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(dicts)], "_ord long, value string")
    return prepare(records.from_lines(found, keep=("_ord",)))


class Fixed(OfflineProvider):
    """Scores by id; ids that begin with x get no reply, those with e fail the whole call."""

    def score(self, rows, context):
        if any(str(r["prompt"]).startswith("e") for r in rows):
            raise ValueError("broken")
        out = super().score([r for r in rows if not str(r["prompt"]).startswith("x")], context)
        for r, o in zip([r for r in rows if not str(r["prompt"]).startswith("x")], out):
            o["overall_score"], o["is_safe"] = (3.0 if "low" in r["prompt"] else 9.0), "unsafe" not in r["prompt"]
        return out


def test_filter_reasons_in_order(spark):
    dicts = [{"text": "fine " + LONG}, {"text": "low " + LONG}, {"text": "unsafe " + LONG}, {"text": "x " + LONG}, {"text": "hi"}, {"text": ""}, {"text": "fine " + LONG + " "}]
    result = Run(PipelineConfig(classification="off", dedup_method="exact", quality_audit_batch_size=1), Fixed()).run(rows_of(spark, dicts))
    found = {r._ord: (r.stage, r.reason) for r in result.rows.collect()}
    assert found == {
        0: (None, None),
        1: ("filter", "Final quality score 3.00 is below 7.00."),
        2: ("filter", "Record failed the safety assessment."),
        3: ("filter", "Provider scoring failed: Batch audit returned no score for this item_id."),
        4: ("filter", "Final quality score 2.00 is below 7.00."),
        5: ("validate", "no usable text"),
        6: ("dedup", "exact_duplicate"),
    }
    assert result.accepted.count() == 1 and result.rejected.count() == 6
    assert result.metrics["stages"]["dedup"]["rejected"] == 1 and result.rejection_reasons["dedup: exact_duplicate"] == 1
    assert result.metrics["accepted_records"] == 1 and result.metrics["input_records"] == 7
    assert evaluation.contract_violations(result.report, {"max_rejected_fraction": 0.9, "required_network_policy": "strict"}) == []


def test_a_failed_call_marks_its_records(spark):
    result = Run(PipelineConfig(classification="off", dedup_method="off"), Fixed()).run(rows_of(spark, [{"text": "e " + LONG}]).coalesce(1))
    assert result.rows.first().reason == "Provider scoring failed: broken"


def test_strict_contract_changes_nothing(spark):
    dicts = [{"text": f"mail me@example.org {LONG}", "label": k % 2} for k in range(2)] + [{"text": f"mail me@example.org {LONG}", "label": 1}]
    config = PipelineConfig(accuracy_contract="strict", dedup_method="exact")
    result = Run(config).run(rows_of(spark, dicts))
    assert [r.text for r in result.accepted.orderBy("_ord").collect()] == [d["text"] for d in dicts]
    m = result.metrics["stages"]
    assert (m["pii"]["policy"], m["dedup"]["method"], m["score_refine"]["mode"], m["filter"]["action"], m["classify"]["action"]) == ("off", "off", "off", "skipped", "strict_existing_labels")


def test_pii_policy_by_label(spark):
    text = "Anna from Rome wrote me@example.org about 900/1800/1900 MHz, call +1 415 555 2671 now " + LONG
    config = PipelineConfig(quality_mode="off", dedup_method="off")
    for label, policy in ((1, "identifiers"), (None, "all")):
        rows = [{"text": text} | ({"label": label} if label else {}), {"text": "Plain " + LONG} | ({"label": 2} if label else {})]
        result = Run(config).run(rows_of(spark, rows))
        got = result.accepted.orderBy("_ord").first().text
        assert "Anna from Rome" in got and "900/1800/1900 MHz" in got and "<EMAIL_ADDRESS>" in got and "<PHONE_NUMBER>" in got
        assert result.metrics["stages"]["pii"]["policy"] == policy and result.metrics["stages"]["pii"]["redacted_records"] == 1
    chat = {"messages": [{"role": "user", "content": "me@example.org"}, {"role": "assistant", "content": "ok then, fine"}]}
    result = Run(config).run(rows_of(spark, [chat]))
    assert result.accepted.first().messages[0].content == "<EMAIL_ADDRESS>" and result.accepted.first().prompt_text == "<EMAIL_ADDRESS>"


def test_dedup_methods(spark):
    near = LONG + " and more of it"
    dicts = [{"text": LONG, "label": 0}, {"text": near, "label": 1}]
    for method, labelled, want in (("auto", True, "exact"), ("auto", False, "minhash"), ("semantic", False, "semantic"), ("semantic-local", True, "semantic-local")):
        rows = dicts if labelled else [{"text": d["text"]} for d in dicts]
        result = Run(PipelineConfig(quality_mode="off", dedup_method=method, classification="off")).run(rows_of(spark, rows))
        m = result.metrics["stages"]["dedup"]
        assert m["method"] == want and m["rejected"] == (0 if want == "exact" else 1)
        if want != "exact":
            assert result.rejected.first().reason.startswith({"minhash": "minhash_near_dup (threshold 0.88)", "semantic": "semantic_dup (sim: ", "semantic-local": "semantic_local_dup (sim: "}[want])
    with pytest.raises(ValueError, match="dedup_method"):
        PipelineConfig(dedup_method="sematic")


def test_sampled_audit_and_classes(spark):
    rows = rows_of(spark, [{"text": f"sample {k} {LONG}"} for k in range(20)])
    config = PipelineConfig(quality_mode="sampled", quality_sample_size=5, classification="binary", classes=("sample", "other"), dedup_method="off")
    result = Run(config).run(rows)
    m = result.metrics["stages"]
    assert (m["score_refine"]["scored"], m["score_refine"]["remote_batches"], m["filter"]["action"], m["classify"]["action"]) == (5, 1, "skipped", "classified")
    assert {tuple(r.labels) for r in result.accepted.collect()} == {("sample",)} and result.metrics["accepted_records"] == 20


def test_refined_records_are_scored_again(spark):
    dicts = [{"instruction": "low   words", "input": "", "output": LONG}, {"text": "low " + LONG}]
    result = Run(PipelineConfig(classification="off", dedup_method="off", filter_min_score=1.0, quality_audit_batch_size=1), Fixed()).run(rows_of(spark, dicts))
    a, b = result.rows.orderBy("_ord").collect()
    assert (a.instruction, a.refined, b.refined) == ("Low words", True, None) and result.metrics["stages"]["score_refine"]["refined"] == 1


def test_plugins_fail_closed(spark):
    plugins.register_validator("short", lambda: F.when(F.char_length("content") < 20, F.array(F.lit("too short"))).otherwise(F.array().cast("array<string>")))
    plugins.register_validator("broken", lambda: F.lit(None))
    plugins.register_recogniser("badge", "BADGE", r"B-\d{4}")
    base = {"quality_mode": "off", "dedup_method": "off", "classification": "off"}
    rows = rows_of(spark, [{"text": "small"}, {"text": "badge B-1234 " + LONG}])
    result = Run(PipelineConfig(validators=("short",), recognisers=("badge",), **base)).run(rows)
    assert result.rejected.first().reason == "too short" and result.accepted.first().text.startswith("badge <BADGE>")
    with pytest.raises(plugins.PluginError, match="not registered"):
        Run(PipelineConfig(validators=("absent",), **base)).run(rows)
    with pytest.raises(Exception, match="gave no list"):
        Run(PipelineConfig(validators=("broken",), **base)).run(rows)


def test_profile(spark):
    one = lambda dicts: profile_records(rows_of(spark, dicts), OfflineProvider())
    assert one([])["reasoning"] == "Dataset is empty."
    p = one([{"text": "t", "labels": ["a", "b"]}, {"text": "u", "labels": ["b"]}])
    assert (p["task_type"], p["classes"], p["confidence"], p["existing_label_field"], p["text_fields"]) == ("multi-label", ["a", "b"], 1.0, "labels", ["text"])
    assert one([{"text": "t", "label": 1}])["confidence"] == 0.4
    assert one([{"instruction": "i", "output": "o"}])["confidence"] == 0.99
    assert one([{"text": " "}])["reasoning"] == "No classifiable text field was found."
    assert one([{"text": "t"}, {"other": 1}])["format"] == "custom"


def test_run_file_resumes_and_writes_companions(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in.jsonl"), str(tmp_path / "out.jsonl")
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(d) for d in [{"text": "a " + LONG, "label": 1}, {"text": "a " + LONG, "label": 1}, {"text": ""}, {"text": "b " + LONG, "label": 2}]))
    config = PipelineConfig(quality_mode="off", report_html=True, metrics_text=True, dedup_method="exact")
    done = []
    real = Run.dedup
    monkeypatch.setattr(Run, "dedup", lambda self, rows, state: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        run_file(spark, source, target, config)
    assert json.loads(files.read_text(spark, str(tmp_path / ".out.checkpoint/state.json")))["completed"] == ["validate", "pii", "profile"]
    with pytest.raises(ValueError, match="different input or configuration"):
        run_file(spark, source, target, PipelineConfig(quality_mode="off"))
    monkeypatch.setattr(Run, "dedup", real)
    monkeypatch.setattr(Run, "validate", lambda self, rows, state: done.append(1))
    result = run_file(spark, source, target, config)
    assert not done and result.metrics["accepted_records"] == 2
    assert sorted((r.text[0], r.labels) for r in files.read_dataset(spark, target).collect()) == [("a", 1), ("b", 2)] or sorted((r.text[0], str(r.labels)) for r in files.read_dataset(spark, target).collect()) == [("a", "1"), ("b", "2")]
    assert sorted(r.rejection.stage for r in files.read_dataset(spark, str(tmp_path / "out.rejected.jsonl")).collect()) == ["dedup", "validate"]
    report = json.loads(files.read_text(spark, str(tmp_path / "out.report.json")))
    assert report["rejection_reasons"] == {"dedup: exact_duplicate": 1, "validate: no usable text": 1} and report["metrics"]["stages"]["classify"]["action"]
    assert "<html>" in files.read_text(spark, str(tmp_path / "out.report.html")) and "gristmill_stage_records" in files.read_text(spark, str(tmp_path / "out.metrics.prom"))
    assert not (tmp_path / ".out.checkpoint").exists()


def test_curate_matches_its_parts(spark):
    rows = [(1, "Mail a@b.org now, please do"), (2, "mail c@d.org now, please do".capitalize()), (3, ""), (4, None), (5, "[TODO: all of it]"), (6, " [TODO: all of it] ")]
    df = spark.createDataFrame(rows, "k long, text string")
    out = {r.k: (r.stage, r.reason, r.response) for r in curate(df, "k", CurateConfig(min_score=6.0)).collect()}
    assert out[1] == (None, None, "Mail <EMAIL_ADDRESS> now, please do") and out[2][:2] == ("dedup", "exact_duplicate")
    assert out[3][0] == out[4][0] == "validate" and out[5][0] == "filter" and out[6][0] == "dedup"
    near = {r.k: r.stage for r in curate(df, "k", CurateConfig("near", threshold=0.5)).collect()}
    assert near[2] == "dedup" and near[1] is None


def test_redaction_steps_and_order(spark):
    texts = ["a@b.org 10.0.0.1 and 192.168.100.200", "call +1 415 555 2671", "4111111111111111", "sk-" + "a" * 48, "é1234567890", "", None, "no signs here"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in textf.redaction_steps(df, "text").collect()}
    same = {r.id: r.text for r in df.select("id", textf.redact(F.col("text")).alias("text")).collect()}
    assert {k: r.text for k, r in got.items()} == same
    assert same[0] == "<EMAIL_ADDRESS> <IP_ADDRESS> and <PHONE_NUMBER>" and same[4] == "é1234567890" and same[6] is None
    assert (got[0].n_email_address, got[0].n_phone_number, got[0].n_ip_address) == (1, 1, 1) and got[3].n_api_key == 1


def test_two_places_as_printf_writes_them(spark):
    """Middles, their neighbours, and shares whose shortest digits end in 5."""
    values = [0.285, 6.975, 0.365, 0.125, 0.375, 0.625, 0.875, 1.005, 2.675, 0.0, 0.005, 0.995, 9.995, -0.285, -0.001, 10.0, 1e7 + 0.125, float("inf")]
    values += [1.0 - a / b for b in (200, 400, 1000, 2000) for a in range(1, b, 3)]
    values += [float(np.nextafter(k / 200, side)) for k in range(1, 400, 2) for side in (-1, 9)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_places(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in out if math.isfinite(r.v) and r.s != f"{r.v:.2f}"] == [] and len(out) == len(values)
    rows = spark.createDataFrame([("", " ".join(f"w{k}" for k in range(127)) + " w0" * 75)], "prompt string, response string")
    ratio = rules.repeat_ratio
    text = rows.select(ratio("response")).first()[0]
    assert f"(repeat ratio: {text:.2f})" in rules.rule_issues(rows).first().issues[-1]


def test_rejection_reasons_of_null_and_blank_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from gristmill import catalog

    long = "one two three four five six"
    rows = [(0, None), (1, ""), (2, "  "), (3, "\n\t"), (4, "abc"), (5, long), (6, f" {long}\n"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    asked = dict(con.execute(catalog.oracle_sql()["rejection_reasons"]).fetchall())
    got = {r.reason: r.n for r in catalog.queries()["rejection_reasons"](spark, str(tmp_path)).collect()}
    assert got == asked == {"dedup: exact_duplicate": 5, "filter: quality score 2.00 below 6.00": 2}


def test_texts_are_written_only_by_stages_that_change_them(spark, tmp_path, monkeypatch):
    from gristmill.plans import pipeline

    written, cut = {}, pipeline.cut
    monkeypatch.setattr(pipeline, "cut", lambda df, label="work": written.setdefault(label, cut(df, label)))
    rows = rows_of(spark, [{"text": LONG}, {"text": LONG}, {"text": ""}, {"instruction": "Say more", "output": LONG}])
    config = PipelineConfig(dedup_method="exact", classification="off", scrub_pii=False)
    result = Run(config).run(rows)
    texts = {"text", "raw", "output", "content", "classify_text", "response_text"}
    assert {k: texts & set(v.columns) for k, v in written.items() if k in ("stage-validate", "stage-dedup", "stage-filter", "profile")} == {"stage-validate": {"text", "raw", "output"}, "stage-dedup": set(), "stage-filter": set(), "profile": set()}
    assert result.rows.columns == rows.columns
    got = {r["_ord"]: (r.stage, r.text, r.content, r.raw) for r in result.rows.collect()}
    assert got[1][0] == "dedup" and got[2][0] == "validate" and got[0][1:3] == got[1][1:3] == (LONG, LONG) and json.loads(got[3][3])["output"] == LONG
    kept = Run(config).run(rows, str(tmp_path / "run"), "f")
    again = Run(config).run(rows, str(tmp_path / "run"), "f")  # all from the folder
    key = lambda r: r["_ord"]
    assert sorted(again.rows.drop("stage").collect(), key=key) == sorted(kept.rows.drop("stage").collect(), key=key) and {r["_ord"]: r.text for r in again.rows.collect()} == {k: v[1] for k, v in got.items()}
