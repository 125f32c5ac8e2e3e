"""Operators that ask a provider, measures, the gate, runs, the command line and streams."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import cli, report
from gristmill.governance.access import AccessPolicy, PermissionDenied
from gristmill.governance.runs import AuditStore, RunConflict, RunRegistry, canonical_digest
from gristmill.governance.sbom import package_url, sbom
from gristmill.operators import analysis, gate, generate, metrics
from gristmill.providers.base import NetworkForbidden, ProviderError, RateLimiter, create_provider, is_local_host, register_provider
from gristmill.providers.offline import HashedNgrams, OfflineProvider
from gristmill.streaming.incremental import append_new, curate_stream


class Partial(OfflineProvider):
    """Leaves out ids that end with 1."""

    def refine(self, rows, mode):
        return super().refine([r for r in rows if not str(r["id"]).endswith("1")], mode)

    def evolve(self, rows):
        raise ValueError("no")

    def classify(self, rows, task, classes):
        return [{"id": r["id"], "labels": ["other"] if "bad" in r["text"] else [classes[0]], "confidence": 0.5} for r in rows]

    def prefer(self, rows):
        raise ProviderError("no key")


def records(spark, n=4):
    return spark.createDataFrame([(k, f"ask  {k}", f"answer {k}. And more of it.", "alpaca") for k in range(n)], "id long, prompt string, response string, fmt string")


def test_missing_replies_keep_records(spark):
    got = {r.id: r for r in generate.refine(records(spark), "id", Partial()).collect()}
    assert (got[0].prompt, got[0].response, got[0].refined) == ("Ask 0", "Answer 0. And more of it.", True)
    assert (got[1].prompt, got[1].refined, got[1].refinement_error) == ("ask  1", False, "Batch refinement returned no entry for this item_id.")
    only = {r.id: r for r in generate.refine(records(spark), "id", OfflineProvider(), "prompt_only").collect()}
    assert (only[2].prompt, only[2].response) == ("Ask 2", "answer 2. And more of it.")
    failed = generate.evolve(records(spark), "id", Partial()).collect()
    assert all((r.original_id, r.evolution_error) == (None, "no") and r.prompt.startswith("ask") for r in failed)
    with pytest.raises(Exception, match="no key"):
        generate.preference_pairs(records(spark), "id", Partial()).collect()


def test_evolve_cycles_strategies_and_ids_hold(spark):
    one, two = ({r.original_id: (r.id, r.evolution_type) for r in generate.evolve(records(spark, 7).repartition(k), "id", OfflineProvider()).collect()} for k in (1, 4))
    assert one == two and [one[str(k)][1] for k in range(4)] == ["deepen_reasoning", "add_constraints", "concretize", "deepen_reasoning"]
    pair = generate.preference_pairs(records(spark, 1), "id", OfflineProvider()).first()
    assert (pair.fmt, pair.chosen, pair.rejected) == ("dpo", "answer 0. And more of it.", "answer 0.")


def test_positions_and_batches(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert {(r.k, r.p) for r in analysis.positions(rows, "k", "p").collect()} == {(k, k) for k in range(1000)}
    assert {(r.k, r.batch) for r in generate.batch_index(rows, "k", 20).collect()} == {(k, k // 20) for k in range(1000)}
    assert sorted(r.k for r in analysis.representative_sample(rows, "k", 5).collect()) == [0, 250, 500, 749, 999]
    assert [r.k for r in analysis.representative_sample(rows, "k", 1).collect()] == [500]
    skewed = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("label")).repartition(4)
    seen, want = Counter(), {}
    for k in range(500):
        label = "hot" if k % 5 else "b" if k % 2 == 0 else None
        want[k] = seen[label] % 3
        seen[label] += 1
    assert {r.id: r.shard for r in analysis.stratified_shard(skewed, "label", "id", 3).collect()} == want


def test_augment_guard(spark):
    rows = [("a", "red apple sweet fruit", "0"), ("b", "green pear sweet fruit", "0"), ("c", "fast blue sports car", "1"), ("d", "slow old diesel car", "1")]
    df = spark.createDataFrame(rows, "id string, text string, label string")

    class Two(OfflineProvider):
        def augment(self, rows, n, hint):
            return [{"id": r["id"], "variations": [r["text"] + " nice", "fast diesel car engine", r["text"]]} for r in rows]

    one, two = (sorted(map(tuple, generate.augment(df.repartition(k), "id", "text", "label", Two(), 3).collect()), key=str) for k in (1, 3))
    assert one == two
    new = [r for r in generate.augment(df, "id", "text", "label", Two(), 3).collect() if r.is_synthetic]
    assert {r.source_id for r in new if r.text.endswith("nice")} == {"a", "b", "c", "d"} and all(r.id.startswith(f"{r.source_id}_aug_") for r in new)
    drift = [r for r in new if r.text == "fast diesel car engine"]
    assert [(r.source_id, r.label) for r in drift] == [("c", "1")]
    for bad, word in ((4, "multiplier"), (0, "multiplier")):
        with pytest.raises(ValueError, match=word):
            generate.augment(df, "id", "text", "label", Two(), bad)
    with pytest.raises(ValueError, match="scalar label"):
        generate.augment(df.withColumn("label", F.lit(None).cast("string")), "id", "text", "label", Two())


def test_classify_whole_calls(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " "), (4, None)], "id long, text string").coalesce(1)
    got = {r.id: r for r in generate.classify(df, "id", "text", Partial(), "binary", ["a", "b"], batch=1).collect()}
    assert (got[1].labels, got[1].classification_error) == (["a"], None)
    assert "labels that are no classes: ['other']" in got[2].classification_error and got[3].classification_error == got[4].classification_error == "No classifiable text found."
    together = {r.id: r.labels for r in generate.classify(df, "id", "text", Partial(), "binary", ["a", "b"]).collect()}
    assert together[1] is None
    for task, classes, word in (("binary", ["a"], "exactly two"), ("multi-class", ["a", "b"], "at least three"), ("multi-label", ["a", " a"], "at least two")):
        with pytest.raises(ValueError, match=word):
            generate.check_classes(task, classes)
    p = OfflineProvider()
    assert generate.resolve_schema(p, "off", None, list)["applicable"] is False
    assert generate.resolve_schema(p, "binary", ["x", " y "], list)["classes"] == ["x", "y"]
    assert generate.resolve_schema(p, "auto", None, lambda: ["t"])["applicable"] is False
    assert generate.resolve_schema(p, "auto", ["x", "y", "z"], lambda: ["t"])["task_type"] == "multi-class"


def test_policies_and_limits():
    assert is_local_host("http://127.0.0.1:80/v1") and is_local_host("192.168.1.5") and is_local_host("box.local") and not is_local_host("http://example.org")
    register_provider("far", lambda **k: OfflineProvider())
    for policy, url in (("strict", None), ("local", "https://example.org"), ("local", None)):
        with pytest.raises(NetworkForbidden):
            create_provider("far", policy=policy, base_url=url)
    assert create_provider("far", policy="local", base_url="http://localhost:1").name == "offline"
    with pytest.raises(ProviderError, match="no provider"):
        create_provider("absent", policy="unrestricted")
    now, slept, tries = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = RateLimiter(2, retries=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.call(lambda: 1)
    assert slept == [60.0]
    with pytest.raises(ValueError, match="again"):
        limiter.call(lambda: tries.append(1) or (_ for _ in ()).throw(ValueError("again")))
    assert len(tries) == 3
    tries.clear()
    with pytest.raises(ProviderError):
        limiter.call(lambda: tries.append(1) or (_ for _ in ()).throw(ProviderError("no")))
    assert len(tries) == 1


def toks(t):
    import re

    return re.findall(r"[a-z0-9_']+", (t or "").lower())


def test_answer_scores(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 12)))
    rows = [(k, say(), say()) for k in range(60)] + [(60, None, ""), (61, "A, b!", "a B")]
    got = {r.k: r for r in metrics.answer_scores(spark.createDataFrame(rows, "k int, p string, e string"), "p", "e").collect()}
    for k, p, e in rows:
        a, b = toks(p), toks(e)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        n = len(a) + len(b)
        both = sum((Counter(a) & Counter(b)).values())
        assert got[k].exact_match == float(a == b) and math.isclose(got[k].token_f1, 2 * both / n if n else 1.0) and math.isclose(got[k].rouge_l, 2 * table[-1][-1] / n if n else 1.0)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 6)).astype(np.float32)
    df = lambda a: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(a)] + [(999, None)], "id long, v array<float>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {k: int((unit[30:][k] @ unit[:30].T).argmax()) for k in range(20)}
    for options in ({"exact": True}, {"exact": True, "lists": 20, "probes": 2}, {"lists": 1}):
        assert {r.query: r.nearest for r in metrics.nearest(df(m[:30]), df(m[30:]), "id", "v", **options).collect()} == want
    assert metrics.nearest(df(m[:0]), df(m[30:]), "id", "v").collect() == []


def test_hygiene_and_recovery(spark):
    rows = [("a", "x", None, None), ("a", "y", "dedup", "copy"), ("a", "x", "dedup", "copy"), ("", "x", "validate", "empty"), ("b", "x", None, None)]
    h = metrics.hygiene_summary(spark.createDataFrame(rows, "t string, l string, stage string, reason string"), "t", "l", "stage", "reason").first()
    assert (h.input_rows, h.retained_rows, h.deleted_rows, h.duplicate_groups, h.duplicate_rows, h.conflicting_groups, h.conflicting_rows, h.empty_rows, h.deletion_rate) == (5, 2, 3, 1, 2, 1, 1, 1, 0.6)
    assert h.deleted_by_stage == {"dedup": 2, "validate": 1} and h.deleted_by_reason == {"dedup: copy": 2, "validate: empty": 1}
    ids = spark.range(4).select(F.col("id").alias("k"))
    clean, actual = (spark.createDataFrame(x, "k long, s string") for x in ([(0, "a"), (1, "b")], [(0, "a"), (2, "c")]))
    r = metrics.recovery_accuracy(ids, "k", clean, actual, "s").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.deletion_f1, r.content_accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_normalisers(spark):
    qa = spark.createDataFrame([(" q ", "c", (["a "],)), ("q", "c", ([],)), ("", "c", (["a"],))], "question string, context string, answers struct<text:array<string>>")
    assert [tuple(r) for r in metrics.normalise(qa, "qa").collect()] == [("q", "c", "a")]
    chat = spark.createDataFrame([([("user", "a"), ("assistant", " ")],), ([("user", "a"), ("assistant", "b")],)], "messages array<struct<role:string,content:string>>")
    assert metrics.normalise(chat, "chat").count() == 1
    dpo = spark.createDataFrame([("p", [("user", "x"), ("assistant", "c")], [("assistant", "r")])], "prompt string, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    assert tuple(metrics.normalise(dpo, "dpo").first()) == ("p", "c", "r")
    assert metrics.normalise(spark.createDataFrame([(" ", "x")], "document string, summary string"), "summarization").count() == 0
    assert metrics.normalise(spark.createDataFrame([("i", "o")], "instruction string, output string"), "alpaca").first().input == ""
    with pytest.raises(ValueError, match="unknown kind"):
        metrics.normalise(qa, "other")


def separable(spark, n, flip=False, seed=0):
    rng = random.Random(seed)
    pools = (["sun", "beach", "summer", "warm"], ["snow", "ice", "winter", "cold"])
    rows = [(f"{seed}-{k}", " ".join(rng.choice(pools[k % 2]) for _ in range(8)), str((k + flip) % 2)) for k in range(n)]
    return spark.createDataFrame(rows, "id string, text string, label string")


def test_accuracy_gate(spark):
    good, bad, held = separable(spark, 80, seed=1), separable(spark, 80, flip=True, seed=2), separable(spark, 30, seed=3)
    better = gate.evaluate_accuracy_gain(bad, good, held, "id", "text", "label", seeds=(1, 2), epochs=2)
    assert better["accepted"] and better["candidate_accuracy_mean"] == 1.0 and better["original_accuracy_mean"] < 0.5
    same = gate.evaluate_accuracy_gain(good, good, held, "id", "text", "label", seeds=(1,), epochs=2)
    assert not same["accepted"] and same["accuracy_gain"] == 0.0
    assert gate.meets_relative(0.1, 0.0, 5) and not gate.meets_relative(0.0, 0.0, 0) and gate.meets_relative(0.55, 0.5, 0.1 - 1e-9)
    for seeds, kw, word in (((), {}, "seed"), ((1,), {"minimum_gain": 0.1, "minimum_relative_gain": 0.1}, "absolute gain or a relative"), ((1,), {"minimum_relative_gain": -1}, "zero or more")):
        with pytest.raises(ValueError, match=word):
            gate.evaluate_accuracy_gain(good, good, held, "id", "text", "label", seeds=seeds, **kw)
    with pytest.raises(ValueError, match=r"can't learn: \{'0': \['candidate'\]\}"):
        gate.evaluate_accuracy_gain(good, good.where("label = '1'"), held, "id", "text", "label", seeds=(1,))


def test_gated_generation_reports_the_best_pool(spark):
    rows, held = separable(spark, 24, seed=1), separable(spark, 10, seed=3)
    pool, found = gate.gated_generation(rows, held, "id", "text", "label", OfflineProvider(), max_iterations=2, seeds=(1,), epochs=1, least_confidence=0.0)
    assert not found["passed"] and found["iterations_used"] == 2 and pool.count() >= 24
    assert found["final_accuracy"] == max(x["accuracy"] for x in found["per_iteration"])
    known = gate.guidance(["1", "2"], {"1": ["snow" * 200]}, {"1": 0.2}, {"1": 0.5})
    assert known == [{"label": "1", "share": 0.2, "wanted_share": 0.5, "taken_for_another": [("snow" * 200)[:300]]}, {"label": "2", "share": 0.0, "wanted_share": None, "taken_for_another": []}]
    assert json.loads(gate.hint(known)) == {"strengthen": known} and gate.hint([]) == ""
    assert gate.weak_labels({"per_label_accuracy": {"b": 0.5, "a": 0.5, "c": 0.1}}, 2) == ["c", "a"]


def test_lineage_with_cycles_and_depth(spark):
    edges = [(k, k + 1) for k in range(130)] + [(5, 2), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "parent long, child long").coalesce(1)
    got = {r.node: r.depth for r in analysis.lineage(df, 125).collect()}
    assert got[130] == 5 and got[125] == 0 and got[0] == -125 + 0 and len(got) == 131
    assert analysis.lineage(df, 125, most=3).count() == 7


def test_runs(spark, tmp_path):
    reg = RunRegistry(spark, str(tmp_path / "runs"))
    a = reg.submit("p", {"x": 1}, key="k")
    assert reg.submit("p", {"x": 1}, key="k") == a
    with pytest.raises(RunConflict, match="idempotency"):
        reg.submit("p", {"x": 2}, key="k")
    with pytest.raises(RunConflict):
        reg.move(a, "succeeded")
    reg.move(a, "running")
    reg.heartbeat(a)
    assert reg.interrupt_stale(3600) == [] and reg.interrupt_stale(-5) == [a]
    b = reg.resume(a)
    reg.move(b, "running")
    for name in ("output", "rejected", "report"):
        (tmp_path / name).write_text(name)
    paths = {n: str(tmp_path / n) for n in ("output", "rejected", "report")}
    with pytest.raises(RunConflict, match="missing required"):
        reg.publish(b, {"output": paths["output"]}, {})
    with pytest.raises(RunConflict, match="accuracy gate"):
        reg.publish(b, paths, {}, need_gain=True)
    reg.publish(b, paths, {"accuracy_gate": {"accepted": True}}, need_gain=True)
    assert reg.verify(b)["verified"]
    (tmp_path / "output").write_text("changed")
    with pytest.raises(RunConflict, match="integrity"):
        reg.verify(b)
    assert {r.node: r.depth for r in reg.lineage(b).collect()} == {b: 0, a: -1}
    assert [r.run_id for r in reg.latest("p", 1).collect()] == [b] and reg.latest("none").count() == 0
    assert canonical_digest({"b": 1, "a": [2]}) == canonical_digest({"a": [2], "b": 1})


def test_audit_store(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "audit"))
    assert store.query().count() == 0
    for k in range(3):
        store.record(recorded_at=f"2024-01-0{k + 1}", provider="x" if k else None, total_tokens=k)
    assert [r.recorded_at for r in store.query(since="2024-01-02", limit=5).collect()] == ["2024-01-03", "2024-01-02"]
    got = {(r.provider, r.is_total): (r.runs, r.total_tokens) for r in store.usage().collect()}
    assert got == {("unknown", False): (1, 0), ("x", False): (2, 3), (None, True): (3, 3)}
    with pytest.raises(ValueError, match="unknown fields"):
        store.record(nothing=1)


def test_access_and_sbom():
    policy = AccessPolicy.from_yaml("name: p\nroles: {ops: {permissions: ['run:score']}}\nactors: {ann: ops, bob: gone}")
    policy.check("ann", "run:score")
    for actor, permission, word in (("ann", "run:merge", "lacks"), ("bob", "run:score", "doesn't define"), ("eve", "run:score", "no actor")):
        with pytest.raises(PermissionDenied, match=word):
            policy.check(actor, permission)
    assert package_url("Pillow_SIMD", "1") == "pkg:pypi/pillow-simd@1"
    doc = sbom()
    assert doc["specVersion"] == "1.5" and "pyspark" in {c["name"].lower() for c in doc["components"]}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"id": str(k), "text": f"The text {k % 3} says a thing or two about words.", "label": k % 2}) for k in range(6)))
    call = lambda *a: (cli.main(list(a), spark), json.loads(capsys.readouterr().out))
    source, out = str(tmp_path / "in.jsonl"), str(tmp_path / "out.jsonl")
    assert call("dedup", source, out)[1] == {"accepted": 3, "rejected": 3}
    assert call("validate", source)[1]["invalid"] == 0
    assert call("score", source, out)[1] == {"scored": 6}
    assert call("stats", source)[1]["total_items"] == 6
    assert call("augment", source, out)[1]["records"] >= 3
    assert call("optimize", source, out, "--quality-mode", "off")[1]["metrics"]["accepted_records"] == 3
    assert call("shard", source, str(tmp_path / "parts"), "--n", "2")[1] == {"partitions": [0, 1]}
    (tmp_path / "c.yaml").write_text("requirements: {max_rejected_fraction: 0.1}")
    code, found = call("contract", str(tmp_path / "c.yaml"), str(tmp_path / "out.report.json"))
    assert code == 1 and found["violations"][0]["requirement"] == "max_rejected_fraction"
    (tmp_path / "p.yaml").write_text("name: p\nroles: {}\nactors: {}")
    with pytest.raises(PermissionDenied):
        cli.main(["--policy", str(tmp_path / "p.yaml"), "--actor", "x", "stats", source], spark)


def test_report_escapes(spark):
    rows = spark.createDataFrame([(1, 8.0, ["<b>"]), (2, None, None), (3, 4.0, ["<b>", "other"])], "_ord long, overall_score double, issues array<string>")
    s = report.summarise(rows.withColumns({c: F.col("overall_score") for c in report.DIMENSIONS}))
    assert (s["total_items"], s["scored_items"], s["mean_score"], s["std_score"], s["top_issues"]) == (3, 2, 6.0, 2.0, [("<b>", 2), ("other", 1)])
    assert "&lt;b&gt;" in report.html_report(s) and "* <b>: 2" in report.markdown_report(s)


def test_streams(spark, tmp_path):
    def drop(name, rows):
        spark.createDataFrame(rows, "at timestamp, id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    from datetime import datetime

    t = datetime(2024, 1, 1)
    drop("in", [(t, 1, "a@b.org here"), (t, 2, " a@b.org here "), (t, 3, ""), (t, 4, None), (t, 5, "other")])
    stream = spark.readStream.schema("at timestamp, id long, text string").parquet(str(tmp_path / "in"))
    query = curate_stream(stream, "at").writeStream.format("memory").queryName("curated").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.text.strip() for r in spark.table("curated").collect()) == ["<EMAIL_ADDRESS> here", "other"]
    for more in ([], [(t, 6, "other"), (t, 7, "new"), (t, 8, "new ")]):
        if more:
            drop("in", more)
        append_new(stream, str(tmp_path / "out"), str(tmp_path / "check"), "id").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 5, 7]


def test_html_text(spark):
    pages = ["<html><head><title>T</title><style>p{}</style></head><body><p>One &amp; two</p><script>x()</script> three</body>", None, "", "<p>open", "plain"]
    got = analysis.html_text(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")).orderBy("k").collect()
    assert [r.text for r in got] == ["T One & two three", "", "", "open", "plain"]


def test_embeddings_are_close_for_close_texts():
    a, b, c, none = HashedNgrams().embed(["the same words here", "the same words  HERE!", "zzz qqq xxx", ""])
    assert a @ b > 0.8 > 0.3 > a @ c and not none.any()


def test_long_records_stay_whole(spark):
    """The provider's reply takes the record's place, so all of a record is sent."""
    text = "one more word. " * 600
    df = spark.createDataFrame([(0, "ask " * 2000, text, "alpaca")], "id long, prompt string, response string, fmt string")
    refined = generate.refine(df, "id", OfflineProvider()).first()
    assert refined.response == "O" + text.strip()[1:] and refined.prompt == "A" + ("ask " * 2000).strip()[1:]
    evolved = generate.evolve(df, "id", OfflineProvider()).first()
    assert evolved.response == text and evolved.prompt.startswith("ask " * 2000)
    pair = generate.preference_pairs(df, "id", OfflineProvider()).first()
    assert pair.chosen == text and pair.prompt == "ask " * 2000 and pair.rejected == "one more word."


def test_guard_judges_long_texts_whole(spark):
    """What tells the label of record 0 stands behind the part that is sent."""
    plain = "same words " * 380
    rows = [(0, plain + "good " * 200, "p"), (1, plain + "bad " * 200, "q"), (2, "bad same words", "q"), (3, "good same words", "p"), (4, "same words same words", "q")]
    out = generate.augment(spark.createDataFrame(rows, "id long, text string, label string"), "id", "text", "label", OfflineProvider()).collect()
    assert "0" in {r.source_id for r in out if r.is_synthetic}


def test_embeddings_are_those_of_plain_counts():
    import xxhash

    texts = ["The  same words", "", "a", "\0\0b \0", "日本語 🙂🙂🙂 x́", "aaa " * 50]
    for n in (1, 2, 3, 5):
        for text, found in zip(texts, HashedNgrams(64, n).embed(texts)):
            data, row = f" {' '.join(text.lower().split())} ", np.zeros(64)
            for k in range(len(data) - n + 1):
                h = xxhash.xxh64_intdigest(data[k : k + n])
                row[h % 64] += 1 if h >> 63 else -1
            assert np.allclose(found, row / (np.linalg.norm(row) or 1), atol=1e-6)
