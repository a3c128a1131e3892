"""Queues and audit events: claims, leases, retries and circuits, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import inside
from larkspur.operators.order import ranked

# Precedence of queues, default priority, retries before the circuit opens.
QUEUES = ["handoffs", "tasks", "reports"]
DEFAULT_PRIORITY, UNREADABLE, MOST_RETRIES = 100, 1_000_000_000, 3


def claim_order(items: DataFrame) -> DataFrame:
    """(queue, name, turn) of (queue, name, priority, readable) by precedence, priority and name."""
    place = F.array_position(F.array(*[F.lit(q) for q in QUEUES]), F.col("queue"))
    priority = F.when(~F.col("readable"), UNREADABLE).otherwise(F.coalesce("priority", F.lit(DEFAULT_PRIORITY)))
    return ranked(items.withColumn("urgency", priority), ["queue"], "urgency", ["name"]).drop("urgency").withColumn("precedence", place)


def retry_circuit(results: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Per (key, seq, ok): failures in a row so far, and whether the circuit is open from then on."""
    w = Window.partitionBy("key").orderBy("seq")
    epoch = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = results.withColumn("epoch", epoch)
    streak = F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy("key", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("retries", streak)
    opened = F.max(F.col("retries") > most).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("circuit_open", opened).drop("epoch")


def _lease(key, frames: Iterator[pd.DataFrame], state):
    owner, until = state.get if state.exists else ("", float("-inf"))
    rows = pd.concat(list(frames)).sort_values(["at", "owner"])
    out = []
    for r in rows.itertuples():
        granted = r.at >= until or r.owner == owner
        if granted:
            owner, until = r.owner, r.at + r.ttl
        out.append((key[0], r.at, r.owner, bool(granted)))
    state.update((owner, float(until)))
    yield pd.DataFrame(out, columns=["resource", "at", "owner", "granted"])


def leases(requests: DataFrame) -> DataFrame:
    """A stream of (resource, at, owner, ttl) requests with whether each is granted: refused only while another's lease runs."""
    return requests.groupBy("resource").applyInPandasWithState(_lease, "resource string, at double, owner string, granted boolean", "owner string, until double", "append", "NoTimeout")


def leases_batch(requests: DataFrame) -> DataFrame:
    """The same over a table."""

    class Fresh:
        exists = False

        def update(self, value):
            pass

    def fold(key, frame):
        return next(_lease(key, iter([frame]), Fresh()))

    return requests.groupBy("resource").applyInPandas(fold, "resource string, at double, owner string, granted boolean")


def valid_envelopes(items: DataFrame) -> DataFrame:
    """Envelopes (id, kind, schema_version, retry_count) with the first reason to reject each, null if fine."""
    named = F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False))
    reason = F.when(~named, "id").when(~F.coalesce("kind", F.lit("")).isin("report", "task", "handoff"), "kind").when(F.coalesce("schema_version", F.lit(0)) != 1, "schema_version").when(F.coalesce("retry_count", F.lit(0)) < 0, "retry_count")
    return items.withColumn("reject", reason)


# What a policy allows if it says nothing else.
SCOPES, ACTIONS, PREFIXES = ["workspace_artifacts"], ["noop", "write_text"], ["artifacts/"]
PROTECTED = ["SOUL.md", "IDENTITY.md", "AGENTS.md", "USER.md", "MEMORY.md"]


def write_path_fault(path: Column, protected: list[str] = PROTECTED, prefixes: list[str] = PREFIXES) -> Column:
    """Why a path must not be written, null if it may."""
    steps = F.ltrim(path, F.lit("/"))
    escapes = F.exists(F.split(steps, "/"), lambda x: x == "..") | (steps == "")
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | F.startswith(steps, F.lit(prefix))
    return F.when(path.isNull() | (path == ""), "no path").when(escapes, "escapes the workspace").when(steps.isin(protected), "protected path").when(~allowed, "outside allowed prefixes")


def plan_reports(reports: DataFrame, scopes: list[str] = SCOPES) -> DataFrame:
    """Reports (id, schema_version, kind, priority, approval_scope, action) as tasks, or with the reason to reject them."""
    reason = F.when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("kind") != "report", "kind").when(F.col("action").isNull(), "action").when(~F.coalesce(F.col("approval_scope").isin(scopes), F.lit(False)), "approval_scope")
    out = valid_envelopes(reports if "retry_count" in reports.columns else reports.withColumn("retry_count", F.lit(0))).withColumn("reject", reason)
    task = F.when(F.col("reject").isNull(), F.regexp_replace("id", "^(.*?)report-", "$1task-"))
    return out.select(F.col("id").alias("source_report_id"), task.alias("id"), F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"), F.lit(0).alias("retry_count"), "approval_scope", "action", "reject", F.when(F.col("reject").isNull(), "report_to_task").otherwise("report_rejected").alias("transition"))


def execute_tasks(tasks: DataFrame, scopes: list[str] = SCOPES, actions: list[str] = ACTIONS) -> DataFrame:
    """Tasks (id, schema_version, kind, retry_count, approval_scope, action_type, path, content) as handoffs with what is to be written and its hash, or rejected."""
    writes = F.col("action_type") == "write_text"
    fault = write_path_fault(F.col("path"))
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("kind") != "task", "kind")
        .when(~F.coalesce(F.col("approval_scope").isin(scopes), F.lit(False)), "approval_scope").when(~F.coalesce(F.col("action_type").isin(actions), F.lit(False)), "action")
        .when(writes & fault.isNotNull(), fault).when(writes & F.col("content").isNull(), "content")
    )
    out = valid_envelopes(tasks).withColumn("reject", reason)
    made = F.col("reject").isNull()
    return out.select(F.col("id").alias("task_id"), F.when(made, F.regexp_replace("id", "^(.*?)task-", "$1handoff-")).alias("id"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "action_type", F.when(made & writes, F.ltrim("path", F.lit("/"))).alias("artifact_path"), F.when(made & writes, F.sha2(F.col("content").cast("binary"), 256)).alias("expected_sha256"), F.when(made & writes, F.col("content")).alias("content"), "reject", F.when(made, "task_to_handoff").otherwise("task_rejected").alias("transition"))


def verify_handoffs(handoffs: DataFrame, artifacts: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Handoffs (id, task_id, retry_count, action_type, artifact_path, expected_sha256) against artifacts (path, sha256): accepted, rejected with the task queued again, or the circuit opened."""
    seen = artifacts.select(F.col("path").alias("artifact_path"), F.col("sha256").alias("real"))
    rows = handoffs.join(seen, "artifact_path", "left")
    good = F.when(F.col("artifact_path").isNull(), (F.col("action_type") == "noop") & F.col("expected_sha256").isNull()).otherwise(F.col("real").eqNullSafe(F.col("expected_sha256")))
    again = F.coalesce("retry_count", F.lit(0)) + 1
    step = F.when(good, "handoff_accepted").when(again > most, "circuit_opened").otherwise("handoff_rejected")
    return rows.select("id", "task_id", step.alias("transition"), F.when(step == "handoff_rejected", again).alias("requeued_with"))


def next_item(items: DataFrame, circuit_open: bool = False, lease_free: bool = True) -> DataFrame:
    """What one tick takes: the first item of the first queue that has one; nothing while the circuit is open or another holds the lease."""
    if circuit_open or not lease_free:
        return items.limit(0)
    place = F.array_position(F.array(*[F.lit(q) for q in QUEUES]), F.col("queue"))
    priority = F.when(~F.col("readable"), UNREADABLE).otherwise(F.coalesce("priority", F.lit(DEFAULT_PRIORITY)))
    return items.orderBy(place, priority, "name").limit(1)


def probation(changes: DataFrame, suites: DataFrame) -> DataFrame:
    """(change_id, outcome, reason) of changes (change_id, run) by their suites' verdicts (run, executed, failed, green): promoted, reverted, or active without one."""
    rows = changes.join(suites, "run", "left")
    why = F.when(F.size("failed") > 0, F.array_join("failed", ",")).otherwise("all_skipped")
    outcome = F.when(F.col("green").isNull(), "active").when(F.col("green"), "promoted").otherwise("reverted")
    return rows.select("change_id", outcome.alias("outcome"), F.when(outcome == "reverted", F.concat(F.lit("probation_failed:"), F.col("change_id"), F.lit(":"), why)).alias("reason"))


def begin_probation(changes: DataFrame) -> DataFrame:
    """Of pending changes (change_id, started, outcome) the one that may begin: the first, and only if none is active."""
    active = changes.where("outcome = 'active'").agg((F.count("*") > 0).alias("busy"))
    return changes.where("outcome is null").orderBy("started", "change_id").limit(1).join(F.broadcast(active)).where("not busy").drop("busy")  # one row


def check_proposals(operations: DataFrame, files: DataFrame, allowed: list[str], immutable: list[str], most: int = 4, most_bytes: int = 65_536) -> DataFrame:
    """(proposal, reject) of operations (proposal, seq, op, path, expected_sha256, bytes) against files (path, sha256): the first reason against each proposal, null if none.

    An operation writes or deletes a path inside the base that is allowed and not immutable;
    it names the hash of what is there, or "absent"; a path comes once; the bytes written have a limit.
    """
    from larkspur.operators.changes import immutable as matches
    from larkspur.operators.health import immutable_patterns

    rows = operations.join(files.select("path", F.col("sha256").alias("now")), "path", "left")
    rows = rows.join(operations.groupBy("proposal", "path").agg(F.min("seq").alias("first")), ["proposal", "path"])
    fault = (
        F.when(~F.coalesce(F.col("op").isin("write", "delete"), F.lit(False)), "operation").when(~inside(F.col("path")), "path escapes base")
        .when(F.col("seq") > F.col("first"), "duplicate path").when(~matches(F.col("path"), allowed) | matches(F.col("path"), immutable_patterns(immutable)), "outside the envelope")
        .when(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("expected_sha256")), "stale hash")
        .when(F.col("now").isNull() & (F.coalesce("expected_sha256", F.lit("absent")) != "absent"), "must be absent")
        .when((F.col("op") == "write") & F.col("bytes").isNull(), "content").when((F.col("op") == "delete") & F.col("now").isNull(), "nothing to delete")
    )
    per = rows.withColumn("fault", fault).groupBy("proposal").agg(F.count("*").alias("n"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("seq"))).alias("first"), F.sum(F.when(F.col("op") == "write", F.col("bytes"))).alias("bytes"))
    return per.select("proposal", F.when(F.col("n") > most, "too many operations").otherwise(F.coalesce("first", F.when(F.col("bytes") > most_bytes, "too many bytes"))).alias("reject"))


def guarded(writes: DataFrame, most_files: int = 25, most_bytes: int = 8 << 20, suffixes: tuple = (".md", ".txt", ".json", ".jsonl", ".csv", ".zip")) -> DataFrame:
    """(run, seq, rule) of writes (run, seq, name, bytes) in order: policy-ok, or the rule that denies it; denied writes use nothing up."""
    suffix = F.regexp_extract("name", r"[^/](\.[^./]*)$", 1)
    rows = writes.withColumn("rule", F.when(~inside(F.col("name")), "path-escape").when(~suffix.isin(*suffixes), "suffix-not-allowed"))

    def fold(key, frame):
        files = used = 0
        out = []
        for seq, size, rule in frame.sort_values("seq")[["seq", "bytes", "rule"]].itertuples(index=False):
            if not isinstance(rule, str):
                rule = "max-files" if files + 1 > most_files else "max-total-bytes" if used + size > most_bytes else "policy-ok"
                files, used = files + (rule == "policy-ok"), used + (size if rule == "policy-ok" else 0)
            out.append((key[0], seq, rule))
        return pd.DataFrame(out, columns=["run", "seq", "rule"])

    return rows.select("run", "seq", "bytes", "rule").groupBy("run").applyInPandas(fold, f"run {writes.schema['run'].dataType.simpleString()}, seq long, rule string")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond the batch operators: events per type and event-time window, of a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
