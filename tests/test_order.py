"""The order of the input over files, splits and arguments; rows without, of equal and of repeated keys."""

import json
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill import catalog_runs
from gristmill.operators import analysis, dedup, generate, metrics
from gristmill.plans import pipeline
from gristmill.providers.offline import OfflineProvider
from gristmill.sources import files
from gristmill.streaming.incremental import append_near, append_new


def write(path, names):
    path.write_text("".join(json.dumps({"text": x}) + "\n" for x in names))


@pytest.fixture
def unequal(tmp_path):
    """Files of 1, 2,000 and 3 lines; Spark reads the largest first."""
    folder = tmp_path / "in.jsonl"
    folder.mkdir()
    names = [f"{f}{k}" for f, n in (("a", 1), ("b", 2000), ("c", 3)) for k in range(n)]
    for f in "abc":
        write(folder / f"{f}.jsonl", [x for x in names if x[0] == f])
    return str(folder), names


def test_order_over_files_and_splits(spark, unequal):
    path, names = unequal
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", before):  # some splits a file, and one for all files
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = pipeline.read_records(spark, path)
            assert [r.text for r in rows.orderBy("_ord").collect()] == names
            assert sorted(r._ord for r in rows.collect()) == list(range(len(names)))
            assert [r.text for r in files.read_dataset(spark, path, max_rows=5).collect()] == names[:5]
            assert {r.n: r.text for r in files.read_dataset(spark, path, number="n").collect()} == dict(enumerate(names))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "txt", "arrow", "yaml"])
def test_order_of_other_containers(spark, tmp_path, kind):
    folder = tmp_path / f"in.{kind}"
    folder.mkdir()
    names = []
    for f, n in (("a", 1), ("b", 300)):
        part = [f"{f}{k}" for k in range(n)]
        names += part
        files.write_dataset(spark.createDataFrame([(x,) for x in part], "text string").coalesce(1), str(folder / f"{f}.{kind}"), single=True)
    assert [r.text for r in files.read_dataset(spark, str(folder), max_rows=3, fmt=kind).collect()] == names[:3]
    assert [r.text for r in pipeline.read_records(spark, str(folder), kind).orderBy("_ord").collect()] == names


def test_merge_keeps_the_order_of_arguments(spark, tmp_path, unequal):
    path, names = unequal
    write(tmp_path / "z.jsonl", ["z0", "z1"])
    files.merge_files(spark, [str(tmp_path / "z.jsonl"), path], str(tmp_path / "out.jsonl"))
    assert [r.text for r in files.read_dataset(spark, str(tmp_path / "out.jsonl"), number="n").orderBy("n").collect()] == ["z0", "z1", *names]
    rows = pipeline.read_records(spark, [str(tmp_path / "z.jsonl"), path])
    assert [r.text for r in rows.orderBy("_ord").limit(3).collect()] == ["z0", "z1", "a0"]


def test_links_are_refused(spark, tmp_path):
    write(tmp_path / "real.jsonl", ["x"])
    (tmp_path / "link.jsonl").symlink_to(tmp_path / "real.jsonl")
    folder = tmp_path / "folder"
    folder.mkdir()
    write(folder / "fine.jsonl", ["x"])
    assert files.check_input(spark, str(folder)) > 0 and files.check_input(spark, str(tmp_path / "real.jsonl")) > 0
    (folder / "out.jsonl").symlink_to(tmp_path / "real.jsonl")
    for path in (tmp_path / "link.jsonl", folder):
        with pytest.raises(files.InputTooLarge, match="regular files"):
            files.check_input(spark, str(path))


def test_shards_of_null_and_equal_orders(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "b")]
    df = spark.createDataFrame(rows, "o long, label string")
    found = analysis.stratified_shard(df, "label", "o", 2).collect()
    assert len(found) == len(rows)
    for label, sizes in (("a", [2, 2]), (None, [1, 1]), ("b", [1])):
        shards = [r.shard for r in found if r.label == label]
        assert sorted(shards.count(s) for s in set(shards)) == sizes
    assert sorted(str((r.o, r.label)) for r in found) == sorted(map(str, rows))
    files.partition_files(df, str(tmp_path / "p"), 2, "label", "o")
    assert spark.read.json(str(tmp_path / "p")).count() == len(rows)


def test_perplexity_row_by_row(spark):
    rows = [(1, "a b c d"), (1, "a b x y z"), (None, "a b"), (2, "x")]
    out = metrics.perplexity_filter(spark.createDataFrame(rows, "id long, text string"), "id", "text", 100.0).collect()
    assert sorted((str(r.id), r.text) for r in out) == sorted((str(i), t) for i, t in rows)
    assert {r.text: r.kept for r in out}["x"] is False and len({r.perplexity for r in out if r.id == 1}) == 2


def test_balanced_cap_with_null_labels(spark):
    df = spark.createDataFrame([(k, (None, "a", "b")[k % 3]) for k in range(30)], "id long, label string")
    out = analysis.balanced_cap(df, "label", "id", 10).collect()
    assert sorted([r.label for r in out].count(x) for x in (None, "a", "b")) == [3, 3, 4] and [r.label for r in out].count(None) == 4
    assert analysis.balanced_cap(df, "label", "id", 2).count() == 2


def test_augment_keeps_records_of_one_id(spark):
    rows = [(1, "good words in a row here", "p"), (1, "other bad words come along now", "q"), (None, "third text without any id", "p"), (2, "good words in a row here", "p")]
    out = generate.augment(spark.createDataFrame(rows, "id long, text string, label string"), "id", "text", "label", OfflineProvider()).collect()
    old = [r for r in out if not r.is_synthetic]
    assert sorted((str(r.id), r.text) for r in old) == sorted((str(i), t) for i, t, _ in rows[:3])
    assert all(r.id is not None for r in out if r.is_synthetic)


def test_stream_of_null_and_equal_orders(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(None, "x"), (None, "x"), (5, "y"), (5, "y"), (None, "z"), (7, "z"), (8, None)]
    spark.createDataFrame(rows, "o long, text string").write.parquet(source)
    for _ in range(2):
        append_new(spark.readStream.schema("o long, text string").parquet(source), target, str(tmp_path / "ck"), "o").awaitTermination()
    assert sorted((str(r.o), r.text) for r in spark.read.parquet(target).collect()) == [("5", "y"), ("None", "x"), ("None", "z")]


def test_near_dedup_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    """Three batches in order give what near_keep gives for all rows; a batch that comes again adds nothing."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(90):
        base = list(rng.choice(texts)) if texts and rng.random() < 0.5 else [rng.choice(words) for _ in range(80)]
        if rng.random() < 0.6:
            base[rng.randrange(80)] = rng.choice(words)
        texts.append(base)
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)] + [(90, None), (91, ""), (92, "a b")]
    whole = spark.createDataFrame(rows, "o long, text string")
    want = sorted(r.ord for r in dedup.near_keep(whole, "o", "text", 0.7).where("keep").collect())
    source, target = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[31 * k : 31 * k + 31], "o long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("o long, text string").parquet(str(source))
        append_near(stream, target, str(tmp_path / "ck"), "o", t=0.7).awaitTermination()
    found = spark.read.parquet(f"{target}/rows")
    assert sorted(r.o for r in found.collect()) == want and 10 < len(want) < 80
    append_near(spark.readStream.schema("o long, text string").parquet(str(source)), target, str(tmp_path / "ck"), "o", t=0.7).awaitTermination()
    assert found.count() == len(want)
    shutil.rmtree(tmp_path / "ck")  # all comes again, as one batch of number 0, in place of what was there
    append_near(spark.readStream.schema("o long, text string").parquet(str(source)), target, str(tmp_path / "ck"), "o", t=0.7).awaitTermination()
    assert sorted(r.o for r in spark.read.parquet(f"{target}/rows/batch=0").collect()) == want


def test_input_order_of_many_rows(spark, tmp_path):
    """Several map tasks, whose rows come in any order, and folders that several ranges share."""
    n = 40_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog_runs.input_order(spark, str(tmp_path))
    assert out.count() == n and out.where("place <> cast(id as long)").count() == 0


def test_small_model_is_not_shuffled_to(spark):
    """Token pairs aren't dealt by their words where the model is small; a large model gives the same."""
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(40))) for k in range(30)] + [(30, "x"), (31, None)], "id long, text string")
    train = df.where("id < 10")
    steps = metrics._transitions(df, "id", "text", metrics.bigram_model(train, "text"), 0.1)
    plan = steps._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Aggregate" not in plan.split("BroadcastExchange")[0].split("BroadcastHashJoin")[0]
    found = []
    for most in (1_000_000, 0):
        before, metrics.BROADCAST = metrics.BROADCAST, most
        try:
            one = metrics.language_model(train, df, "id", "text").first()
            each = {r.id: r.perplexity for r in metrics.perplexity(df, "id", "text", train).collect()}
        finally:
            metrics.BROADCAST = before
        found.append((one, each))
    (a, x), (b, y) = found
    assert a.eval_transitions == b.eval_transitions == 30 * 39 and abs(a.perplexity - b.perplexity) < 1e-9 and a.next_token_accuracy == b.next_token_accuracy
    assert x.keys() == y.keys() and all(x[k] == y[k] or abs(x[k] - y[k]) < 1e-9 for k in x)
    shuffled = metrics.perplexity(df, "id", "text", train)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in shuffled and ", a#" not in shuffled.split("Aggregate [id", 1)[1].split("]")[0]
