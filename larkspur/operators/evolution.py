"""Changes of a store of files that are gated: proposals on probation, notes in two tiers, repair to a fixed point.

State is a versioned Store; each function makes one version or none, so a change to
several tables happens whole or not at all, and of two writers one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import changes, health, notes
from larkspur.operators.links import checkpointed
from larkspur.sources.versioned import Store, Version, update
from larkspur.streaming import dispatch

FILES = "path string, content string"
PROPOSALS = "name string, change_id string, reason string, seq long, op string, path string, expected_sha256 string, content string, state string, why string"
PROBATION = "change_id string, snapshot array<struct<path: string, content: string>>, state string, why string, position long"
HISTORY = 25


def sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _empty(store: Store, schema: str) -> DataFrame:
    return store.spark.createDataFrame([], schema)


def begin_store(store: Store, files: DataFrame, proposals: DataFrame | None = None) -> Version:
    """The first version of a store of files (path, content) and pending proposals."""
    return store.commit(store.current(), {"files": files.select("path", "content"), "proposals": proposals if proposals is not None else _empty(store, PROPOSALS), "probation": _empty(store, PROBATION)})


def _status(store: Store, at: Version) -> str | None:
    """Why no change may begin: an open circuit or a change on probation."""
    row = store.table("probation", at).agg(F.coalesce(F.bool_or(F.col("state") == "circuit_open"), F.lit(False)).alias("open"), F.coalesce(F.bool_or(F.col("state") == "active"), F.lit(False)).alias("busy")).first()
    return "circuit_open" if row.open else "active_probation" if row.busy else None


def apply_one(store: Store, allowed: list[str], immutable: list[str], most: int = 4, most_bytes: int = 65_536) -> dict:
    """Takes the first pending proposal by name: refused, or applied and on probation with a snapshot of what it touched.

    A proposal names the hash of each file it changes.  It is judged against the version that
    its own commit follows; if another writer commits first, it is judged again, so a hash
    that has gone stale is refused and never overwritten.  Nothing is applied while the
    circuit is open or a change is on probation.
    """
    out: dict = {}

    def change(store: Store, at: Version):
        out.clear()
        blocked = _status(store, at)
        if blocked:
            out.update(status="blocked", reason=blocked)
            return None
        files, proposals = store.table("files", at), store.table("proposals", at)
        first = proposals.where("state = 'pending'").orderBy("name").limit(1).select("name", "change_id").first()
        if first is None:
            out.update(status="no_proposal")
            return None
        own = F.col("name") == first.name
        ops = proposals.where(own)
        # only what the proposal names, so no join takes all files to the driver
        there = files.join(F.broadcast(ops.select("path")), "path", "left_semi")
        judged = ops.select(F.col("name").alias("proposal"), "seq", "op", "path", "expected_sha256", F.octet_length("content").alias("bytes"))
        why = dispatch.check_proposals(judged, there.select("path", sha(F.col("content")).alias("sha256")), allowed, immutable, most, most_bytes).first().reject
        state = "rejected" if why else "applied"
        told = proposals.withColumn("why", F.when(own, F.lit(why)).otherwise(F.col("why"))).withColumn("state", F.when(own, state).otherwise(F.col("state")))
        out.update(status=state, proposal=first.name, reason=why, change_id=first.change_id)
        if why:
            return {"proposals": told}, {"event": "proposal_rejected", "proposal": first.name}
        after = files.join(ops.select("path"), "path", "left_anti").unionByName(ops.where("op = 'write'").select("path", "content"))
        before = ops.select("path").join(there, "path", "left").agg(F.sort_array(F.collect_list(F.struct("path", "content"))).alias("snapshot"))  # at most ``most`` files
        begun = before.select(F.lit(first.change_id).alias("change_id"), "snapshot", F.lit("active").alias("state"), F.lit(None).cast("string").alias("why"), F.lit(at.number + 1).cast("long").alias("position"))
        return {"files": after, "proposals": told, "probation": store.table("probation", at).unionByName(begun)}, {"event": "proposal_applied_probationary", "proposal": first.name}

    update(store, change)
    return out


def evaluate(store: Store, executed: int, failed: list[str]) -> dict:
    """Ends the probation: kept if tests ran and none failed, else the snapshot is put back, what was new goes, and the circuit opens."""
    out: dict = {}

    def change(store: Store, at: Version):
        out.clear()
        rows = store.table("probation", at)
        active = rows.where("state = 'active'")
        one = active.select("change_id").first()
        if one is None:
            out.update(status="no_active_probation")
            return None
        green = executed > 0 and not failed
        why = None if green else f"probation_failed:{one.change_id}:{','.join(failed) or 'all_skipped'}"
        state = "promoted" if green else "reverted"
        out.update(status=state, change_id=one.change_id, reason=why)
        ended = rows.withColumn("why", F.when(F.col("state") == "active", F.lit(why)).otherwise(F.col("why"))).withColumn("state", F.when(F.col("state") == "active", state).otherwise(F.col("state")))
        ended = ended.orderBy(F.desc("position")).limit(HISTORY)
        tables = {"probation": ended}
        if not green:
            was = active.select(F.explode("snapshot").alias("s")).select("s.path", "s.content")
            tables["files"] = store.table("files", at).join(was.select("path"), "path", "left_anti").unionByName(was.where("content is not null"))
            opened = _empty(store, PROBATION).unionByName(store.spark.createDataFrame([(one.change_id, None, "circuit_open", why, at.number + 1)], PROBATION))
            tables["probation"] = ended.unionByName(opened)
        return tables, {"event": state, "change_id": one.change_id}

    update(store, change)
    return out


def close_circuit(store: Store) -> None:
    """Lets changes begin again."""
    update(store, lambda store, at: ({"probation": store.table("probation", at).where("state <> 'circuit_open'")}, {"event": "circuit_closed"}))


# ---- repair to a fixed point


def repair(store: Store, rules: DataFrame, now: Column, protected: list[str], most: int = 10) -> list[dict]:
    """Checks files (path, content, modified), repairs what diverges, and checks again until nothing is left to repair.

    Rules are those of health.heal_checks with a column ``repair``: delete_matching removes the
    files that a rule finds, restore_from_snapshot puts back their newest content among the
    store's table ``snapshots`` (snapshot_id, path, content), report_only only tells.  Deleting
    protected paths is refused; a rule that fired in each of the last three runs of the table
    ``runs`` (run_no, rule; rule null for a run's own row) is held back.  Each round is one
    version: the files, a snapshot of those about to change, and the run, together.  Returns for each round
    its number, the rules that fired, and how many findings of each status there were.
    """
    out: list[dict] = []

    def change(store: Store, at: Version):
        files, runs, snapshots = (store.table(t, at) for t in ("files", "runs", "snapshots"))
        sized = files.select("path", F.size(F.split("content", "\n")).alias("lines"), "modified")
        found = checkpointed(health.heal_checks(rules, sized, now))
        hit = found.join(F.broadcast(rules.select("id", "repair")), "id").withColumn("guarded", changes.immutable(F.col("path"), protected))
        refused = hit.where("guarded and repair = 'delete_matching'").select("id").distinct().withColumn("refused", F.lit(True))
        held = changes.quarantined(runs, runs=runs.select("run_no").distinct()).select(F.col("rule").alias("id"), F.lit(True).alias("held"))
        status = F.when(F.col("refused"), "refused_immutable").when(F.col("held"), "quarantined_oscillation").when(F.col("repair") == "report_only", "reported").otherwise("repaired")
        told = checkpointed(hit.join(F.broadcast(refused), "id", "left").join(F.broadcast(held), "id", "left").withColumn("status", status).select("id", "path", "repair", "status"))
        work = told.where("status = 'repaired'")
        gone = work.where("repair = 'delete_matching'").select("path").distinct().join(files.select("path"), "path", "left_semi")
        newest = snapshots.groupBy("path").agg(F.max_by("content", "snapshot_id").alias("content"))  # before the join, so a path with many snapshots meets it once
        newest = newest.join(work.where("repair = 'restore_from_snapshot'").select("path").distinct(), "path", "left_semi")
        put = newest.join(files.select("path", F.col("content").alias("is")), "path", "left").where(~F.col("content").eqNullSafe(F.col("is"))).select("path", "content")
        moved = checkpointed(gone.withColumn("content", F.lit(None).cast("string")).unionByName(put))
        number = (runs.agg(F.max("run_no")).first()[0] or 0) + 1
        counts = {r.status: r.n for r in told.groupBy("status").agg(F.count("*").alias("n")).collect()}
        fired = [r.id for r in work.select("id").distinct().orderBy("id").collect()]  # a list that people write
        before = files.join(moved.select("path"), "path", "left_semi").select(F.lit(number).cast("long").alias("snapshot_id"), "path", "content")
        after = files.join(moved.select("path"), "path", "left_anti").unionByName(moved.where("content is not null").withColumn("modified", now))
        ran = store.spark.createDataFrame([(number, None), *[(number, r) for r in fired]], "run_no long, rule string")
        out.append({"run": number, "fired": fired, "statuses": counts, "changed": moved.count()})
        return {"files": after, "snapshots": snapshots.unionByName(before), "runs": runs.unionByName(ran)}, {"event": "repair", "run": number}

    for _ in range(most):
        update(store, change)
        if not out[-1]["changed"]:
            break
    return out
