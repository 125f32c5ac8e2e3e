"""A registry of runs in a table: their states, lineage, artifacts and their digests, usage and cost.

Events are appended as Parquet rows and a run's state is the last event's, so writers never change a file that another
reads. Two writers that act on one run at the same time are ordered by time, and a cancellation wins over later events.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis
from ..sources import files

#: States of a run, and those each may follow.
FOLLOWS = {"queued": (None,), "running": ("queued",), "succeeded": ("running",), "failed": ("queued", "running"), "cancelled": ("queued", "running"), "interrupted": ("running",)}
#: States after which a run can be resumed as a new one.
RESUMABLE = ("failed", "cancelled", "interrupted")
STALE_SECONDS = 120
_EVENTS = "event_id string, at timestamp, run_id string, parent_run_id string, project string, actor string, status string, key string, detail string"


class RunConflict(RuntimeError):
    """The run's state or identity doesn't allow this."""


def canonical_digest(value) -> str:
    """SHA-256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class RunRegistry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _events(self) -> DataFrame:
        root, fs = files._fs(self.spark, f"{self.folder}/events")
        if not fs.exists(root):
            return self.spark.createDataFrame([], _EVENTS)
        return self.spark.read.schema(_EVENTS).parquet(f"{self.folder}/events")

    def _append(self, run_id: str, status: str, project: str, actor: str = "", parent: str | None = None, key: str | None = None, detail=None, at: datetime | None = None) -> None:
        row = (uuid.uuid4().hex, at or datetime.now(UTC), run_id, parent, project, actor, status, key, json.dumps(detail))
        self.spark.createDataFrame([row], _EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/events")

    def runs(self) -> DataFrame:
        """One row per run: its first event's identity, its last state (heartbeats aside), and when it was last heard of."""
        e = self._events()
        moved = F.when(F.col("status") != "heartbeat", F.struct((F.col("status") == "cancelled").cast("int").alias("c"), "at", "event_id", "status", "detail"))
        one = e.groupBy("run_id").agg(F.min_by("project", "at").alias("project"), F.min_by("actor", "at").alias("actor"), F.min_by("parent_run_id", "at").alias("parent_run_id"), F.min_by("key", "at").alias("key"), F.min_by("detail", "at").alias("spec"), F.min("at").alias("created_at"), F.max("at").alias("heard_at"), F.max(moved).alias("m"))
        return one.select("run_id", "project", "actor", "parent_run_id", "key", "spec", "created_at", "heard_at", F.col("m.status").alias("status"), F.col("m.detail").alias("detail"))

    def get(self, run_id: str):
        found = self.runs().where(F.col("run_id") == run_id).first()
        if found is None:
            raise KeyError(f"no run {run_id}")
        return found

    def submit(self, project: str, spec: dict, actor: str = "", key: str | None = None, parent: str | None = None) -> str:
        """A new queued run; a key that the project used before gives the run of that time, if the spec is the same."""
        if key is not None:
            old = self.runs().where((F.col("project") == project) & (F.col("key") == key)).first()
            if old is not None:
                if canonical_digest(json.loads(old["spec"])) != canonical_digest(spec):
                    raise RunConflict("the idempotency key belongs to another specification")
                return old["run_id"]
        if parent is not None:
            self.get(parent)
        run_id = uuid.uuid4().hex
        self._append(run_id, "queued", project, actor, parent, key, spec)
        return run_id

    def move(self, run_id: str, status: str, actor: str = "", detail=None) -> None:
        now = self.get(run_id)
        if status not in FOLLOWS or now["status"] not in FOLLOWS[status]:
            raise RunConflict(f"a run that is {now['status']} can't become {status}")
        self._append(run_id, status, now["project"], actor, detail=detail)

    def heartbeat(self, run_id: str) -> None:
        now = self.get(run_id)
        if now["status"] != "running":
            raise RunConflict(f"run is {now['status']}")
        self._append(run_id, "heartbeat", now["project"])

    def interrupt_stale(self, seconds: int = STALE_SECONDS, at: datetime | None = None) -> list[str]:
        """Mark running runs that were not heard of for so long; their ids."""
        limit = F.lit(at or datetime.now(UTC)) - F.expr(f"interval {int(seconds)} seconds")
        gone = [r["run_id"] for r in self.runs().where((F.col("status") == "running") & (F.col("heard_at") < limit)).collect()]
        for run_id in gone:
            self.move(run_id, "interrupted")
        return gone

    def resume(self, run_id: str, actor: str = "") -> str:
        """A new run of the same specification, child of one that ended without success."""
        old = self.get(run_id)
        if old["status"] not in RESUMABLE:
            raise RunConflict("a run goes on only after it failed or was cancelled or interrupted")
        return self.submit(old["project"], json.loads(old["spec"]), actor, parent=run_id)

    def latest(self, project: str, limit: int = 100) -> DataFrame:
        """The project's newest runs, 1 to 1000 of them."""
        return self.runs().where(F.col("project") == project).orderBy(F.desc("created_at"), "run_id").limit(max(1, min(1000, limit)))

    def lineage(self, run_id: str) -> DataFrame:
        """node, depth: ancestors (negative) and descendants (positive) of a run, at most 1000 of each; cycles end."""
        self.get(run_id)
        edges = self.runs().where("parent_run_id is not null").select(F.col("parent_run_id").alias("parent"), F.col("run_id").alias("child"))
        return analysis.lineage(edges, run_id, most=1000)

    def publish(self, run_id: str, artifacts: dict[str, str], metrics: dict, need_gain: bool = False) -> dict:
        """End a run well: its manifest has each artifact's path and digest. output, rejected and report are required."""
        if missing := {"output", "rejected", "report"} - set(artifacts):
            raise RunConflict(f"missing required files: {sorted(missing)}")
        if need_gain and not (metrics.get("accuracy_gate") or {}).get("accepted"):
            raise RunConflict("the accuracy gate was asked for and is not passed")
        manifest = {"run_id": run_id, "artifacts": {k: {"path": v, "sha256": path_digest(self.spark, v)} for k, v in artifacts.items()}, "metrics": metrics}
        self.move(run_id, "succeeded", detail=manifest)
        return manifest

    def verify(self, run_id: str) -> dict:
        """Whether a published run's artifacts are what they were."""
        run = self.get(run_id)
        if run["status"] != "succeeded":
            raise RunConflict("nothing has been published by this run")
        manifest = json.loads(run["detail"])
        for item in manifest["artifacts"].values():
            if path_digest(self.spark, item["path"]) != item["sha256"]:
                raise RunConflict("integrity: a file is not what was published")
        return {"run_id": run_id, "verified": True, "artifacts": len(manifest["artifacts"])}


def path_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents' digests of a file or folder's files; contents are hashed by tasks, a file each."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("d"))
    one = each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "d"))), lambda x: F.concat_ws(" ", x["name"], x["d"])), "\n"), 256).alias("d")).first()
    return one["d"]


#: Columns of an audit record.
AUDIT = "run_id string, recorded_at string, actor string, command string, input_path string, output_path string, provider string, model string, accepted_records long, rejected_records long, input_tokens long, output_tokens long, total_tokens long, network_policy string, status string, detail string"


class AuditStore:
    """Append-only records of what was run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def record(self, **values) -> str:
        names = [f.split(" ")[0] for f in AUDIT.split(", ")]
        if unknown := set(values) - set(names):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        values = {"run_id": uuid.uuid4().hex, "recorded_at": datetime.now(UTC).isoformat()} | values
        self.spark.createDataFrame([tuple(values.get(n) for n in names)], AUDIT).coalesce(1).write.mode("append").parquet(self.folder)
        return values["run_id"]

    def query(self, since: str | None = None, limit: int | None = None, **equal) -> DataFrame:
        """Records with all the given values, from `since` on (ISO text), the newest first."""
        root, fs = files._fs(self.spark, self.folder)
        rows = self.spark.read.schema(AUDIT).parquet(self.folder) if fs.exists(root) else self.spark.createDataFrame([], AUDIT)
        for k, v in equal.items():
            if v is not None:
                rows = rows.where(F.col(k) == v)
        if since is not None:
            rows = rows.where(F.col("recorded_at") >= since)
        rows = rows.orderBy(F.desc("recorded_at"), "run_id")
        return rows if limit is None else rows.limit(limit)

    def usage(self, **equal) -> DataFrame:
        """Runs, records and tokens per provider and model, and in all (both null, of is_total)."""
        rows = self.query(**equal).select(F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("model", F.lit("unknown")).alias("model"), "accepted_records", "rejected_records", "input_tokens", "output_tokens", "total_tokens")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns[2:]]
        grouped = rows.groupBy("provider", "model").agg(F.count("*").alias("runs"), *sums).withColumn("is_total", F.lit(False))
        total = rows.agg(F.count("*").alias("runs"), *sums).select(F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("model"), "runs", *rows.columns[2:], F.lit(True).alias("is_total"))
        return grouped.unionByName(total)

