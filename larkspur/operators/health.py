"""Checks of a store of files: scope, digests, age, size, suites, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import glob_to_regex, lines_of
from larkspur.operators.links import checkpointed

# Paths that no configuration can make mutable.
FLOOR = [
    "SOUL.md", "IDENTITY.md", "USER.md", "AGENTS.md", "scripts/snapshot.py", "scripts/probation.py", "scripts/evolution.py", "scripts/test_*.py",
    "autonomy/config/invariants.json", "autonomy/config/regression.json", "autonomy/config/evolution.json", "autonomy/state/probation.json",
    "autonomy/state/circuit-breaker.json", "autonomy/snapshots/*", "autonomy/snapshots/**", "Memory/_archive/*", "Memory/_archive/**",
]
# Paths on which no repair may delete.
HEAL_FLOOR = [
    "SOUL.md", "IDENTITY.md", "scripts/self_heal.py", "scripts/snapshot.py", "scripts/probation.py", "scripts/tick.py", "scripts/evolution.py", "scripts/test_*.py",
    "autonomy/config/invariants.json", "autonomy/config/regression.json", "autonomy/config/evolution.json", "autonomy/state/probation.json",
    "autonomy/snapshots/*", "autonomy/snapshots/**",
]
# Caps of the first tier, and the share of them from which it is under pressure.
BYTE_CAP, LINE_CAP, NOTE_CAP, WARN = 12288, 200, 12, 0.85


def immutable_patterns(configured: list[str], floor: list[str] = FLOOR) -> list[str]:
    """The configured patterns and the floor, which they cannot shrink: FLOOR for proposals, HEAL_FLOOR for repairs."""
    return sorted({*floor, *configured})


def collisions(paths: DataFrame) -> DataFrame:
    """(name, paths): base names that several paths share, which cannot be staged side by side."""
    named = paths.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path").distinct()
    return named.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def missing(scope: DataFrame, staged: DataFrame) -> DataFrame:
    """Paths of the scope that are not staged."""
    return scope.select("path").distinct().join(staged.select("path"), "path", "left_anti")


def canonical_digest(files: DataFrame) -> DataFrame:
    """One row (digest, files): a hash of all (path, bytes, sha256) in ascending order of path.

    Each stretch of paths is hashed by itself and the stretches' hashes together, so that no
    task holds the whole list.
    """
    part = F.substring(F.sha2("path", 256), 1, 2)
    row = F.struct("path", "bytes", "sha256")
    parts = files.select(part.alias("part"), "path", "bytes", "sha256").groupBy("part").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda p: p["h"]), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))  # at most 256 parts


def canonical_list(files: DataFrame) -> DataFrame:
    """One row (digest): the hash of one JSON list of all files, for scopes that fit one task."""
    raw = F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256")))
    text = F.to_json(F.transform(raw, lambda r: F.struct(r["bytes"].alias("bytes"), r["path"].alias("path"), r["sha256"].alias("sha256"))))
    return files.agg(F.sha2(text, 256).alias("digest"))


def heal_checks(rules: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """(id, path): what each rule (id, check, pattern, regex, arg) finds among files (path, lines, modified).

    file_exists finds its target if it is lacking, max_line_count a file with more lines,
    files_older_than and glob_nonempty the files that match and are older, or all.  regex is
    glob_to_regex() of the pattern, crosses=False.
    """
    exact = rules.where("check in ('file_exists', 'max_line_count')")
    # rules are a list that people write, so they go to the files: most of these lie in a few folders
    named = checkpointed(files.join(F.broadcast(exact), F.col("pattern") == F.col("path")).select("id", "check", "pattern", "lines", "arg"))
    lost = exact.where("check = 'file_exists'").join(named.select("pattern").distinct(), "pattern", "left_anti").select("id", "pattern")
    long = named.where("check = 'max_line_count' and lines > arg").select("id", "pattern")
    found = lost.unionByName(long).select("id", F.col("pattern").alias("path"))
    # a file meets the globs whose fixed folder it lies in, by an equi-join on its folders
    globs = rules.where("check in ('files_older_than', 'glob_nonempty')").withColumn("folder", F.regexp_extract("pattern", r"^((?:[^/*?\[]+/)*)", 1))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.concat(F.slice(steps, 1, n), F.when(n > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))
    globbed = files.withColumn("folder", F.explode(folders)).join(F.broadcast(globs), "folder").where(F.expr("path rlike regex"))
    old = F.unix_timestamp("modified") < F.unix_timestamp(now) - F.col("arg")
    return found.unionByName(globbed.where((F.col("check") == "glob_nonempty") | old).select("id", "path"))


def suite_verdict(results: DataFrame) -> DataFrame:
    """(run, executed, failed, green) of (run, id, status): green takes a test that ran and none that failed; skipped ones prove nothing."""
    ran = F.count_if(F.col("status").isin("passed", "failed"))
    missed = F.array_sort(F.collect_set(F.when(F.col("status").startswith("failed"), F.col("id"))))
    out = results.groupBy("run").agg(ran.alias("executed"), missed.alias("failed"))
    return out.withColumn("green", (F.col("executed") > 0) & (F.size("failed") == 0))


def pressure(used: Column, cap: int = BYTE_CAP) -> Column:
    return F.when(used >= cap, "RED").when(used / cap >= WARN, "AMBER").otherwise("GREEN")


def mutation(text: Column, old: Column, new: Column) -> Column:
    """What a text becomes if old, which must occur once, is replaced: result, sizes and state; a reason if it cannot be."""
    n = F.when(F.length(old) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")
    result = F.when(n == 1, F.replace(text, old, new))
    size, lines, notes = F.octet_length(result), F.size(lines_of(result)), F.regexp_count(result, F.lit(r"(?m)^### \[MEM-\d{4}-\d{4}\]"))
    over = lambda share: (size > share * BYTE_CAP) | (lines > share * LINE_CAP) | (notes > share * NOTE_CAP)
    near = (size / BYTE_CAP >= WARN) | (lines / LINE_CAP >= WARN) | (notes / NOTE_CAP >= WARN)
    state = F.when(over(1), "RED").when(near, "AMBER").otherwise("GREEN")
    return F.struct(result.alias("result"), (F.octet_length(new) - F.octet_length(old)).alias("delta_bytes"), size.alias("projected_bytes"), lines.alias("lines"), notes.alias("notes"), F.when(n == 1, state).alias("state"), F.when(n != 1, F.concat(F.lit("occurs "), n.cast("string"), F.lit(" times"))).alias("reject"))


def glob_rules(rules: list[tuple[str, str, str, float]]) -> list[tuple[str, str, str, str, float]]:
    """Rows (id, check, pattern, regex, arg) of (id, check, pattern, arg); an unknown check is an error."""
    known = {"file_exists", "max_line_count", "files_older_than", "glob_nonempty"}
    unknown = [r[1] for r in rules if r[1] not in known]
    if unknown:
        raise ValueError(f"unknown checks: {unknown}")
    return [(i, check, pattern, glob_to_regex(pattern, crosses=False), float(arg)) for i, check, pattern, arg in rules]
