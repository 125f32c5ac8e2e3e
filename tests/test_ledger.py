"""Provider stages that are stopped and go on, and rates that tasks share."""

import json
from collections import Counter

import pytest

from gristmill.operators import generate, records
from gristmill.plans.pipeline import PipelineConfig, Run, prepare
from gristmill.providers.base import Calls, ProviderError, RateLimiter
from gristmill.providers.ledger import Ledger
from gristmill.providers.offline import OfflineProvider

LONG = " ".join(f"word{k}" for k in range(60))


class Logged(OfflineProvider):
    """Writes down what it is asked; gives up on the records of `bad` while the file `broken` is there."""

    def __init__(self, folder, bad=()):
        super().__init__()
        self.folder, self.bad = str(folder), set(bad)

    def score(self, rows, context):
        import os
        import uuid

        if os.path.exists(f"{self.folder}/broken") and any(r["id"] in self.bad for r in rows):
            raise ProviderError("no credentials any more")
        with open(f"{self.folder}/{uuid.uuid4().hex}.log", "w") as f:
            json.dump([r["id"] for r in rows], f)
        return super().score(rows, context)


def asked(folder):
    return Counter(i for p in folder.glob("*.log") for i in json.loads(p.read_text()))


def prepared(spark, n):
    lines = [(k, json.dumps({"text": f"text {k} " + LONG})) for k in range(n)]
    return prepare(records.from_lines(spark.createDataFrame(lines, "_ord long, value string").repartition(4), keep=("_ord",)))


def test_a_stopped_stage_asks_for_the_rest_only(spark, tmp_path):
    (tmp_path / "broken").touch()
    config = PipelineConfig(classification="off", dedup_method="off", quality_audit_batch_size=5)
    run = lambda: Run(config, Logged(tmp_path, {150})).run(prepared(spark, 200), str(tmp_path / "run"), "same")
    with pytest.raises(Exception, match="no credentials"):
        run()
    before = asked(tmp_path)
    assert 0 < len(before) < 200 and 150 not in before
    (tmp_path / "broken").unlink()
    result = run()
    after = asked(tmp_path)
    assert set(after) == set(range(200)) and max(after.values()) == 1  # nothing twice
    assert result.metrics["accepted_records"] == 200 and result.rows.where("overall_score is null").count() == 0


def test_a_plan_that_is_read_twice_asks_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id long, prompt string").repartition(3)
    provider = Logged(tmp_path)
    call = lambda r: provider.score([x | {"response": ""} for x in r], {})
    out = generate.ask(rows, call, generate.SCORES, "none", 4, Calls(ledger=str(tmp_path / "ledger"), commit_calls=1))
    assert out.count() == 40 and out.where("overall_score is not null").count() == 40
    assert max(asked(tmp_path).values()) == 1
    again = generate.ask(rows, call, generate.SCORES, "none", 4, Calls(ledger=str(tmp_path / "ledger")))
    assert sorted(r.id for r in again.collect()) == list(range(40)) and max(asked(tmp_path).values()) == 1


def test_failed_records_are_not_kept(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in range(6)], "id long").coalesce(1)
    calls = Calls(ledger=f"file://{tmp_path}/ledger", retries=1)

    def half(batch):
        return [{"id": r["id"], "v": 1} for r in batch if r["id"] % 2]

    out = generate.ask(rows, half, "v int", "no reply", 2, calls).collect()
    assert {r.id: (r.v, r.error) for r in out} == {k: (1, None) if k % 2 else (None, "no reply") for k in range(6)}
    assert sorted(r.id for r in Ledger(calls.ledger).answers(spark, "id long, v int").collect()) == [1, 3, 5]
    out = generate.ask(rows, lambda b: [{"id": r["id"], "v": 2} for r in b], "v int", "no reply", 2, calls).collect()
    assert {r.id: r.v for r in out} == {k: 1 if k % 2 else 2 for k in range(6)}
    assert Ledger(str(tmp_path / "none")).answers(spark, "id long") is None


def test_shares_keep_to_the_limit():
    for per_minute in (1, 3, 4, 10, 601):
        tasks, share = Calls(per_minute, at_once=4).shares()
        assert tasks <= 4 and tasks * share <= per_minute and share >= 1
        now, times = [0.0], []

        def sleep(s):
            now[0] += s

        for _ in range(tasks):  # tasks that run side by side, by a clock of their own each
            now[0] = 0.0
            limiter = RateLimiter(share, clock=lambda: now[0], sleep=sleep)
            for _ in range(3 * share + 1):
                limiter.acquire()
                times.append(now[0])
        assert all(sum(t <= x < t + 60 for x in times) <= per_minute for t in times)
    assert Calls().shares()[1] is None
    limiter = RateLimiter(None, sleep=lambda s: pytest.fail("no limit, no wait"))
    for _ in range(10_000):
        limiter.acquire()
    for bad in ({"per_minute": 0}, {"at_once": 0}, {"commit_calls": -1}):
        with pytest.raises(ValueError, match="positive"):
            Calls(**bad)


def test_no_more_tasks_than_the_limit_allows(spark):
    rows = spark.range(40).repartition(8)
    out = generate.ask(rows, lambda b: [{"id": r["id"], "v": 1} for r in b], "v int", "none", 50, Calls(per_minute=120, at_once=4))
    assert out.rdd.getNumPartitions() == 4 and out.where("v = 1").count() == 40
