import pytest

from gristmill.operators import dedup, evaluation, records
from gristmill.sources import files


def test_formats_and_containers():
    assert files.path_format("a/b.jsonl.gz") == "jsonl"
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        files.path_format("dataset.unknown")
    assert files.container_rows({"train": [{"text": "a"}], "test": [{"text": "b"}]}) == [{"text": "a", "split": "train"}, {"text": "b", "split": "test"}]
    assert files.container_rows({"text": ["a", "b"], "label": [1, 2]}) == [{"text": "a", "label": 1}, {"text": "b", "label": 2}]
    assert records.record_format(["text", "output"]) == "alpaca"


def test_exact_keep(spark):
    df = spark.createDataFrame([(0, " a b "), (1, "a b"), (2, "c")], "k long, text string")
    assert {r.k: r.keep for r in dedup.exact_keep(df, "k", "text").collect()} == {0: True, 1: False, 2: True}


def test_exact_keep_of_null_texts(spark):
    df = spark.createDataFrame([(0, None), (1, " "), (2, "c"), (3, None)], "k long, text string")
    assert {r.k: r.keep for r in dedup.exact_keep(df, "k", "text").collect()} == {0: True, 1: False, 2: True, 3: False}


def test_copies_of_a_dropped_near_copy_go(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "x"])), (2, " ".join([*words, "x"])), (3, "something else entirely here"), (4, "something else entirely here")]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {r.ord: r.keep for r in dedup.near_keep(df, "k", "text", 0.85).collect()} == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_nb_predict(spark):
    train = spark.createDataFrame([("a", "good fine"), ("b", "bad awful bad"), (None, "good"), ("a", None)], "label string, text string")
    rows = spark.createDataFrame([(1, "fine good"), (2, "bad"), (3, None), (4, "unseen")], "k int, text string")
    got = {r.k: (r.predicted, round(r.confidence, 4)) for r in evaluation.nb_predict(train, rows, "k", "text", "label").collect()}
    assert got[1] == ("a", round(1 / (1 + (1 / 7 / (2 / 6)) ** 2), 4)) and got[2] == ("b", round(1 / (1 + 1 / 6 / (3 / 7)), 4))
    assert got[3] == ("a", 0.5) and got[4] == ("a", round(1 / (1 + 6 / 7), 4))
    assert {r.predicted for r in evaluation.nb_predict(train.where("label = 'a'"), rows, "k", "text", "label").collect()} == {None}


def test_agreement_with_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, "y", None), (4, None, "y")], "k int, a string, p string")
    assert {r.label: (r.tp, r.fp, r.fn) for r in evaluation.class_agreement(df, "a", "p").collect()} == {"x": (1, 0, 1), "y": (0, 2, 1)}
    assert {r.label: (r.n, r.examples) for r in evaluation.diagnose(df, "a", "p", "k", 1).collect()} == {"x": (2, [2]), "y": (1, [3]), None: (1, [4])}
    assert tuple(evaluation.macro_f1(df.where("k > 9"), "a", "p").first()) == (0.0, 0.0)


def test_cost_of_unpriced_providers(spark):
    runs = spark.createDataFrame([("p", 1000, 2000), ("q", 5, 6), (None, 1, 1)], "who string, i long, o long")
    got = {r.provider: (r.cost_usd, r.unpriced_tokens) for r in evaluation.cost_estimate(runs, {"p": {"input_per_1k": 1.0}}, "who", "i", "o").collect()}
    assert got == {"p": (1.0, 0), "q": (None, 11), None: (None, 2)}


def test_contract():
    report = {"metrics": {"accepted_records": 6, "rejected_records": 4, "network_policy": "offline"}, "profile": {"classes": ["a"]}}
    asked = {"max_rejected_fraction": 0.3, "required_network_policy": "offline", "required_classes": ["a", "b"], "min_quality_score": 5.0}
    assert [v["requirement"] for v in evaluation.contract_violations(report, asked)] == ["min_quality_score", "max_rejected_fraction", "required_classes"]
    assert evaluation.contract_violations(report, {}) == []
