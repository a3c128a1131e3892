"""Snapshots, diffs and convergence of file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import glob_to_regex


def diff_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op) of (path, sha256) tables: write or delete; equal ones are left out."""
    b, a = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    op = F.when(F.col("now").isNull(), "delete").when(~F.col("now").eqNullSafe(F.col("was")), "write")
    return b.join(a, "path", "full_outer").select("path", op.alias("op"), "was", "now").where("op is not null")


def restore_plan(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of a snapshot whose current content differs or is missing."""
    c = current.select("path", F.col("sha256").alias("now"))
    return snapshot.join(c, "path", "left").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("path", "sha256", F.col("now").isNull().alias("missing"))


def verify_snapshot(snapshot: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, state): ok, missing or corrupt, from stored blobs (sha256, content)."""
    stored = blobs.select("sha256", F.sha2("content", 256).alias("real"))
    state = F.when(F.col("real").isNull(), "missing").when(F.col("real") != F.col("sha256"), "corrupt").otherwise("ok")
    return snapshot.join(stored, "sha256", "left").select("path", state.alias("state"))


def latest_containing(snapshots: DataFrame) -> DataFrame:
    """(path, snapshot_id): the newest snapshot of each path."""
    return snapshots.groupBy("path").agg(F.max("snapshot_id").alias("snapshot_id"))


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of append-only files (path, content): grown, same, truncated or deleted."""
    both = before.select("path", F.col("content").alias("old")).join(after.select("path", F.col("content").alias("new")), "path", "left")
    state = F.when(F.col("new").isNull(), "deleted").when(F.col("new") == F.col("old"), "same").when(F.startswith("new", "old"), "grown").otherwise("truncated")
    return both.select("path", state.alias("state"))


def immutable(path: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_to_regex(p))
    return hit


def select_scope(listing: DataFrame, required: list[str], include: list[str], exclude: list[str]) -> DataFrame:
    """(path, listed): required paths and those that match an include, but no exclude."""
    asked = listing.sparkSession.createDataFrame([(r,) for r in required], "path string").withColumn("required", F.lit(True))
    rows = listing.select("path").withColumn("listed", F.lit(True)).join(asked, "path", "full_outer")
    keep = F.coalesce("required", F.lit(False)) | immutable(F.col("path"), include)
    return rows.where(keep & ~immutable(F.col("path"), exclude)).select("path", F.coalesce("listed", F.lit(False)).alias("listed"))


def quarantined(history: DataFrame, last: int = 3, runs: DataFrame | None = None) -> DataFrame:
    """Rules of (run_no, rule) that fired in each of the last runs; none while there are fewer runs.

    ``runs`` (run_no) tells all runs, those in which nothing fired too; without it they are
    those of history, where a row without a rule stands for such a run.
    """
    runs = (history if runs is None else runs).select("run_no").distinct().orderBy(F.desc("run_no")).limit(last)
    counted = history.where("rule is not null").join(F.broadcast(runs), "run_no").groupBy("rule").agg(F.countDistinct("run_no").alias("n"))  # at most ``last`` rows
    return counted.where(F.col("n") == last).select("rule")


def convergence(rules: DataFrame, fired: DataFrame, held: DataFrame, protected: list[str]) -> DataFrame:
    """(id, status) of rules (id, target, repair): what happens to each that fired."""
    hit = rules.join(fired.select(F.col("rule").alias("id")), "id", "left_semi").join(held.select(F.col("rule").alias("id"), F.lit(True).alias("held")), "id", "left")
    status = F.when((F.col("repair") == "delete_matching") & immutable(F.col("target"), protected), "refused_immutable").when(F.col("held"), "quarantined").when(F.col("repair") == "report_only", "reported").otherwise("planned")
    return hit.select("id", status.alias("status"))


def worst(findings: DataFrame) -> DataFrame:
    """One row: the worst of GREEN, AMBER, RED."""
    order = {"GREEN": 0, "AMBER": 1, "RED": 2}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("state"))
    return findings.agg(F.element_at(F.array(*[F.lit(k) for k in order]), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("verdict"))


def dedup_blobs(files: DataFrame) -> DataFrame:
    """(sha256, content): one row per content."""
    return files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
