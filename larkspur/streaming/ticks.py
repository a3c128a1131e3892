"""Ticks: each makes one transition of the first waiting item, handoffs before tasks before reports.

State is a versioned Store of ``items``, ``artifacts``, ``circuit`` and ``log``.  A tick is one
commit: the item's move, what it makes, and its log row, so it happens whole or not at all
and two tickers never take the same item.  As a stream, each row is a tick; the log holds
the batch and the turn, so a batch that is replayed after a crash goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from larkspur.sources.versioned import Store, Version, update
from larkspur.streaming import dispatch

ITEMS = "queue string, name string, state string, id string, kind string, schema_version int, priority int, readable boolean, retry_count int, approval_scope string, action_type string, path string, content string, task_id string, artifact_path string, expected_sha256 string"
ARTIFACTS, CIRCUIT, LOG = "path string, content string", "reason string", "batch long, turn long, transition string, queue string, name string, reason string"


def begin_ticks(store: Store, items: DataFrame) -> Version:
    """The first version: items that wait; columns of ITEMS that are absent are null, state is pending."""
    have = {f.split()[0]: f.split()[1] for f in ITEMS.split(", ")}
    rows = items.select(*[(F.col(c) if c in items.columns else F.lit("pending") if c == "state" else F.lit(True) if c == "readable" else F.lit(None)).cast(t).alias(c) for c, t in have.items()])
    none = lambda schema: store.spark.createDataFrame([], schema)
    return store.commit(store.current(), {"items": rows, "artifacts": none(ARTIFACTS), "circuit": none(CIRCUIT), "log": none(LOG)})


def _transition(store: Store, at: Version, pick: Row) -> tuple[dict, str, str | None]:
    """(changed tables, transition, reason) of one item."""
    items = store.table("items", at)
    own = (F.col("queue") == pick.queue) & (F.col("name") == pick.name) & (F.col("state") == "pending")
    row = items.where(own).withColumn("action", F.col("action_type"))
    made, tables = [], {}
    if pick.queue == "reports":
        done = dispatch.plan_reports(row).first()
        why, after = done.reject, "archive"
        if why is None:
            made = [dict(queue="tasks", name=f"{done.id}.json", id=done.id, kind="task", priority=done.priority, retry_count=0, approval_scope=done.approval_scope, action_type=pick.action_type, path=pick.path, content=pick.content)]
        transition, failed = done.transition, "rejected"
    elif pick.queue == "tasks":
        done = dispatch.execute_tasks(row).first()
        why, after = done.reject, "archive"
        if why is None:
            made = [dict(queue="handoffs", name=f"{done.id}.json", id=done.id, kind="handoff", retry_count=done.retry_count, task_id=done.task_id, action_type=done.action_type, artifact_path=done.artifact_path, expected_sha256=done.expected_sha256)]
        transition, failed = done.transition, "failed"
    else:
        seen = store.table("artifacts", at).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
        done = dispatch.verify_handoffs(row, seen).first()
        transition, why, after, failed = done.transition, None, "accepted" if done.transition == "handoff_accepted" else "rejected", "rejected"
        if transition == "circuit_opened":
            why = f"Verification failed for {done.task_id} after retry limit"
            tables["circuit"] = store.spark.createDataFrame([(why,)], CIRCUIT)
    waits = lambda name: (F.col("name") == name) & (F.col("state") == "pending")
    if made and items.where((F.col("queue") == made[0]["queue"]) & waits(made[0]["name"])).take(1):
        why, made, transition = "exists", [], transition.split("_")[0] + "_rejected"
    state = F.when(own, failed if why and pick.queue != "handoffs" else after).otherwise(F.col("state"))
    moved = items.withColumn("state", state)
    if transition == "handoff_rejected":  # the archived task waits again
        again = (F.col("queue") == "tasks") & (F.col("id") == done.task_id) & (F.col("state") == "archive")
        moved = moved.withColumn("retry_count", F.when(again, done.requeued_with).otherwise(F.col("retry_count"))).withColumn("state", F.when(again, "pending").otherwise(F.col("state")))
    if made:
        names = [f.split()[0] for f in ITEMS.split(", ")]
        new = {"state": "pending", "schema_version": 1, "readable": True} | made[0]
        moved = moved.unionByName(store.spark.createDataFrame([tuple(new.get(n) for n in names)], ITEMS))
    if pick.queue == "tasks" and why is None and done.artifact_path is not None:
        kept = store.table("artifacts", at).where(F.col("path") != done.artifact_path)
        tables["artifacts"] = kept.unionByName(store.spark.createDataFrame([(done.artifact_path, done.content)], ARTIFACTS))
    return tables | {"items": moved}, transition, why


def tick(store: Store, batch: int = -1, turn: int = 0) -> str:
    """One transition and its name; idle or circuit_open where there is none to make."""
    name = []

    def change(store: Store, at: Version):
        name.clear()
        stopped = store.table("circuit", at).first()
        pick = None if stopped else dispatch.next_item(store.table("items", at).where("state = 'pending'")).first()
        tables, transition, why = ({}, "circuit_open", stopped.reason) if stopped else ({}, "idle", None) if pick is None else _transition(store, at, pick)
        name.append(transition)
        told = store.spark.createDataFrame([(batch, turn, transition, pick and pick.queue, pick and pick.name, why)], LOG)
        return tables | {"log": store.table("log", at).unionByName(told)}, {"batch": batch, "turn": turn}

    update(store, change)
    return name[0]


def run_batch(store: Store, ticks: DataFrame, batch: int) -> int:
    """Makes the ticks of a micro-batch that its log does not hold yet; how many those were."""
    done = store.table("log").where(F.col("batch") == batch).count()
    asked = ticks.count()
    for turn in range(done, asked):
        tick(store, batch, turn)
    return max(0, asked - done)


def tick_stream(ticks: DataFrame, folder: str, checkpoint: str):
    """A writer of a stream whose every row is a tick; start() runs it."""

    def each(rows: DataFrame, batch: int) -> None:
        run_batch(Store(rows.sparkSession, folder), rows, batch)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
