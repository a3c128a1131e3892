"""Writing notes in two tiers: short ones and stubs in memory, whole ones in an archive.

A versioned Store holds ``memory`` (pos, id, title, body), ``archive`` (path, text) and
``snapshots`` (snapshot_id, digest, reserved).  Memory is small by its caps; the archive
grows.  Each function changes both tables in one version or, if any gate is shut, nothing,
and says why.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import lines_of, slug
from larkspur.operators import notes
from larkspur.operators.health import BYTE_CAP, LINE_CAP
from larkspur.sources.versioned import Store, Version, update

MEMORY, ARCHIVE, SNAPSHOTS = "pos long, id string, title string, body string", "path string, text string", "snapshot_id string, digest string, reserved array<string>"
# Folders of the archive.
CATEGORIES = ["context", "decisions", "lessons", "preferences"]
OWN = r"(?m)\A(?:(?!#[ \t]).*\n)*# (MEM-\d{4}-\d{4})\b"


def begin_notes(store: Store, memory: DataFrame | None = None, archive: DataFrame | None = None) -> Version:
    none = lambda schema: store.spark.createDataFrame([], schema)
    return store.commit(store.current(), {"memory": memory if memory is not None else none(MEMORY), "archive": archive if archive is not None else none(ARCHIVE), "snapshots": none(SNAPSHOTS)})


def note_text() -> Column:
    return F.concat(F.lit("### ["), "id", F.lit("] "), "title", F.lit("\n\n"), F.trim("body"), F.lit("\n"))


def rendered(memory: DataFrame) -> DataFrame:
    """One row (path, text): memory as one Markdown file; its caps keep it small."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", note_text().alias("t"))))
    return memory.agg(F.lit("MEMORY.md").alias("path"), F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("text"))


def digest(memory: DataFrame) -> str:
    return rendered(memory).select(F.sha2(F.col("text").cast("binary"), 256).alias("d")).first().d


def archive_path(store: Store, nid: str, title: str, category: str) -> str:
    made = store.spark.createDataFrame([(title,)], "title string").select(slug(F.col("title")).alias("s")).first().s
    return f"Memory/{category}/{nid}-{made or 'note'}.md"


def _refused(reason: str) -> dict:
    return {"status": "refused", "reason": reason}


def _over_caps(memory: DataFrame) -> str | None:
    r = rendered(memory).select(F.size(lines_of(F.col("text"))).alias("lines"), F.octet_length("text").alias("bytes")).first()
    return "line cap" if r.lines > LINE_CAP else "byte cap" if r.bytes > BYTE_CAP else None


def _gated(store: Store, gates) -> dict:
    """Commits what gates(store, version, out) gives unless it gives a reason."""
    out: dict = {}

    def change(store: Store, at: Version):
        out.clear()
        made = gates(at)
        if isinstance(made, str):
            out.update(_refused(made))
            return None
        tables, told = made
        out.update(status="written", **told)
        return tables, told

    update(store, change)
    return out


def _stub(store: Store, pos: int, nid: str, title: str, fields: dict, path: str) -> DataFrame:
    body = f"- **Stub.** {fields['Confidence']}. {fields['Directive']} Full note: `{path}`"
    return store.spark.createDataFrame([(pos, nid, f"{title} — demoted to L3", body)], MEMORY)


def _names(nid: str, category: str) -> str | None:
    return "id" if not re.fullmatch(notes.ID, nid) else "category" if category not in CATEGORIES else None


def _audited(memory: DataFrame, nid: str, today: Column) -> tuple[list, str | None]:
    """The parsed notes of an id, and what the audit of all notes finds against it."""
    parsed = notes.parse_notes(rendered(memory))
    own = parsed.where(F.col("id") == nid).select("title", "body", "fields", "stub").collect()  # memory is small
    faults = notes.audit_notes(parsed, today).where((F.col("subject") == nid) & (F.col("level") == "FAIL")).select("rule").distinct().orderBy("rule").collect()
    return own, "; ".join(r.rule for r in faults) or None


def create_note(store: Store, nid: str, title: str, category: str, body: str, today: Column) -> dict:
    """A whole note in the archive and its stub first in memory."""

    def gates(at: Version):
        if fault := _names(nid, category):
            return fault
        memory, archive = store.table("memory", at), store.table("archive", at)
        if memory.where(F.col("id") == nid).take(1):
            return "id exists"
        path = archive_path(store, nid, title, category)
        if archive.where(F.col("path") == path).take(1):
            return "path exists"
        low = memory.agg(F.coalesce(F.min("pos"), F.lit(1)).alias("low")).first().low - 1
        own, fault = _audited(memory.unionByName(store.spark.createDataFrame([(low, nid, title, body)], MEMORY)), nid, today)
        if fault or not own:
            return fault or "no note"
        after = memory.unionByName(_stub(store, low, nid, title, own[0].fields, path))
        whole = store.spark.createDataFrame([(path, f"# {nid} — {title}\n\n{body.rstrip()}\n")], ARCHIVE)
        return _over_caps(after) or ({"memory": after, "archive": archive.unionByName(whole)}, {"path": path})

    return _gated(store, gates)


def append_evidence(store: Store, nid: str, item: dict, today: Column, path: str | None = None) -> dict:
    """One more evidence record on a note in memory, or on the whole note at a path of the archive that declares the id."""

    def gates(at: Version):
        if fault := _names(nid, CATEGORIES[0]):
            return fault
        name, key, value, text = ("memory", "id", nid, "body") if path is None else ("archive", "path", path, "text")
        table = store.table(name, at)
        if path is not None and "_archive" in path.split("/"):
            return "archived"
        own = table.where(F.col(key) == value)
        one = own.select(F.col(text).rlike(r"(?m)^\s*-\s+\*\*Stub\.\*\*").alias("stub"), F.regexp_extract(text, OWN, 1).alias("declared")).first()
        if one is None:
            return "not found"
        if path is None and one.stub:
            return "stub"
        if path is not None and one.declared != nid:
            return "heading does not match"
        record = [F.lit(item.get(k)).cast("string").alias(k) for k in ("date", "stance", "source", "quote")]
        done = notes.appended(own.select(F.col(key).alias("note_id"), F.col(text).alias("body"), *record), today).first()
        if done.reject:
            return done.reject
        after = table.withColumn(text, F.when(F.col(key) == value, F.lit(done.updated)).otherwise(F.col(text)))
        return (path is None and _over_caps(after)) or ({name: after}, {"note": nid})

    return _gated(store, gates)


def take_snapshot(store: Store, snapshot_id: str, paths: list[str]) -> dict:
    """Records memory's digest, and which of the paths are free: reserved for what is to come."""

    def gates(at: Version):
        snapshots = store.table("snapshots", at)
        if snapshots.where(F.col("snapshot_id") == snapshot_id).take(1):
            return "snapshot exists"
        there = {r.path for r in store.table("archive", at).where(F.col("path").isin(paths)).select("path").collect()}  # at most the paths asked for
        row = store.spark.createDataFrame([(snapshot_id, digest(store.table("memory", at)), sorted(set(paths) - there))], SNAPSHOTS)
        return {"snapshots": snapshots.unionByName(row)}, {"snapshot_id": snapshot_id}

    return _gated(store, gates)


def distil(store: Store, snapshot_id: str, nid: str, category: str, observation: str, today: Column) -> dict:
    """Moves a note that scoring would distil to the archive, with a new observation, and leaves a stub.

    A snapshot must hold memory as it is now and have reserved the note's path.
    """

    def gates(at: Version):
        line = observation.strip()
        if fault := _names(nid, category):
            return fault
        if not line or re.search(r"[\r\n]", line):
            return "observation"
        memory, archive = store.table("memory", at), store.table("archive", at)
        own, fault = _audited(memory, nid, today)
        if len(own) != 1 or own[0].stub or fault:
            return "not exactly one note" if len(own) != 1 else "stub" if own[0].stub else fault
        note = own[0]
        get = lambda k: F.try_element_at("fields", F.lit(k))
        scored = notes.parse_notes(rendered(memory)).where(F.col("id") == nid).select("id", "stub", notes.date_of(get("Last-Access")).alias("last_access"), notes.date_of(get("Created")).alias("created"), get("Freq").try_cast("long").alias("freq"), get("Salience").try_cast("double").alias("importance"))
        action = notes.score_notes(scored, today).first().action
        if action != "DISTIL":
            return f"action {action}"
        path = archive_path(store, nid, note.title, category)
        kept = store.table("snapshots", at).where(F.col("snapshot_id") == snapshot_id).first()
        if kept is None or kept.digest != digest(memory):
            return "no snapshot" if kept is None else "stale snapshot"
        if path not in kept.reserved or archive.where(F.col("path") == path).take(1):
            return "path not reserved"
        body, n = re.subn(r"(?<=\*\*Observation:\*\*)[^\n·]*", lambda _: f" {line}", note.body, count=1)
        if not n:
            return "no observation"
        pos = memory.where(F.col("id") == nid).first().pos
        after = memory.where(F.col("id") != nid).unionByName(_stub(store, pos, nid, note.title, note.fields, path))
        whole = store.spark.createDataFrame([(path, f"# {nid} — {note.title}\n\n{body.strip()}\n")], ARCHIVE)
        return _over_caps(after) or ({"memory": after, "archive": archive.unionByName(whole)}, {"path": path})

    return _gated(store, gates)
