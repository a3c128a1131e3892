"""Evidence migration: what becomes of each note, projected without touching a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import lines_of, slug
from larkspur.operators.links import NOTE_ID, own_note

# Where archived notes go, files that hold no notes, and how long the projected text may be.
ARCHIVE = "Memory/_archive/evidence-migration"
INDEX_FILES = ["INDEX.md", "INDEX-L3.md", "PROTOCOL.md"]
MOST_LINES, MOST_BYTES = 200, 12288
LINK = rf"\[\[({NOTE_ID})\]\]"
NAMED = r"(Memory/[\w./-]+\.md)"


def archival_documents(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text): staged files (name, text) whose real path (name, path) is a note below /Memory/."""
    wanted = manifest.where(F.startswith("path", F.lit("/Memory/")) & F.endswith("path", F.lit(".md")) & ~F.contains("path", F.lit("/_archive/")) & ~F.element_at(F.split("path", "/"), -1).isin(INDEX_FILES))
    return wanted.join(files, "name").select("path", "text")


def incoming_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, sources): which notes (id, body) and files (path, text) link a note, itself apart."""
    link = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))))
    inner = notes.select(F.col("id").alias("source"), F.col("id").alias("own"), link(F.col("body")).alias("id"))
    outer = files.select(F.col("path").alias("source"), own_note(F.col("path"), F.col("text")).alias("own"), link(F.col("text")).alias("id"))
    return inner.union(outer).where(~F.col("id").eqNullSafe(F.col("own"))).groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def stub_targets(notes: DataFrame) -> DataFrame:
    """(path, id): the last stub (id, pos, stub, body) that names a file."""
    named = notes.where("stub").select("id", "pos", F.posexplode(F.regexp_extract_all("body", F.lit(NAMED), F.lit(1))).alias("at", "named"))
    return named.groupBy(F.concat(F.lit("/"), F.ltrim("named", F.lit("/"))).alias("path")).agg(F.max_by("id", F.struct("pos", "at")).alias("id"))


def archive_path(kind: Column, note_id: Column, path: Column, title: Column) -> Column:
    """Where an archived note goes: by id and title, or below the archive as it lay below /Memory/."""
    made = F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("note"))
    below = F.when(F.contains(path, F.lit("/Memory/")), F.regexp_replace(path, "^.*?/Memory/", "")).otherwise(F.ltrim(path, F.lit("/")))
    return F.when(kind == "L2", F.concat(F.lit(f"{ARCHIVE}/l2/"), note_id, F.lit("-"), made, F.lit(".md"))).otherwise(F.concat(F.lit(f"{ARCHIVE}/"), below))


def plan(entities: DataFrame, decisions: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(note_id, path, target_path, confidence, status, delta_bytes, detail), by note_id and path.

    Entities have id, kind (L2 or L3), path, pos, title, confidence, valid (a ledger without
    fault), labelled (it has evidence lines) and span_bytes; decisions have id, action,
    reject (why the proposed evidence will not do, or null) and added_bytes.  A valid note
    needs no decision; others are archived, unless something active points at them, or get
    the evidence proposed.  Ids given twice block, and so do decisions for no note.
    """
    twice = entities.groupBy("id").agg(F.count("*").alias("copies"))
    hit = links.select("id", F.lit(True).alias("linked"))
    # stubs name files of the second tier; the notes of the first all lie in one file, so they are spread
    apart, second = F.xxhash64("id", "pos", "path"), F.col("kind") == "L3"
    stub = targets.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("salt"), F.lit(True).alias("stubbed"))
    rows = entities.withColumn("file", F.when(second, F.col("path"))).withColumn("salt", F.when(second, F.lit(0)).otherwise(apart)).join(twice, "id").join(decisions.withColumn("decided", F.lit(True)), "id", "left").join(hit, "id", "left").join(stub, ["file", "salt"], "left").drop("file", "salt")
    target = archive_path(F.col("kind"), F.col("id"), F.col("path"), F.col("title"))
    rows = rows.withColumn("goes", F.col("decided").isNotNull() & (F.col("copies") == 1) & ~F.col("valid") & (F.col("action") == "ARCHIVE")).withColumn("to", F.when(F.col("goes"), target))
    # so are those that go nowhere
    rows = rows.withColumn("alone", F.when(F.col("to").isNull(), apart))
    rows = rows.withColumn("turn", F.when(F.col("goes"), F.row_number().over(Window.partitionBy("to", "alone").orderBy("kind", "pos", "path"))))
    held = F.coalesce("linked", F.lit(False)) | ((F.col("kind") == "L3") & F.coalesce("stubbed", F.lit(False)))
    out = lambda status, delta, detail: F.struct(F.lit(status).alias("status"), delta.cast("long").alias("delta_bytes"), detail.alias("detail"))
    block = lambda detail: out("BLOCKED", F.lit(0), detail if isinstance(detail, Column) else F.lit(detail))
    verdict = (
        F.when(F.col("copies") > 1, block("duplicate active self-ID"))
        .when(F.col("valid") & F.col("decided").isNull(), out("READY", F.lit(0), F.lit("evidence present")))
        .when(F.col("valid"), block(F.concat(F.lit("stale decision '"), F.col("action"), F.lit("' for valid note"))))
        .when(F.col("decided").isNull(), block("invalid ledger and no decision"))
        .when(F.col("goes") & (F.col("turn") > 1), block(F.concat(F.lit("duplicate archive target "), F.col("to"))))
        .when(F.col("goes") & held, out("ARCHIVE", F.lit(0), F.lit("archive blocked by active incoming link/stub")))
        .when(F.col("goes"), out("ARCHIVE", F.when(F.col("kind") == "L2", -F.col("span_bytes")).otherwise(0), F.lit("archive")))
        .when((F.col("action") == "ADD") & F.col("labelled"), block("existing evidence malformed; repair or archive"))
        .when((F.col("action") == "ADD") & F.col("reject").isNotNull(), block(F.concat(F.lit("invalid proposed evidence: "), F.col("reject"))))
        .when(F.col("action") == "ADD", out("READY", F.col("added_bytes"), F.lit("evidence added")))
        .otherwise(block(F.concat(F.lit("unsupported action '"), F.col("action"), F.lit("'"))))
    )
    known = rows.withColumn("v", verdict).select(F.col("id").alias("note_id"), "path", F.col("to").alias("target_path"), "confidence", "v.status", "v.delta_bytes", "v.detail")
    lost = decisions.join(entities, "id", "left_anti").select(F.col("id").alias("note_id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("target_path"), F.lit("").alias("confidence"), F.lit("BLOCKED").alias("status"), F.lit(0).cast("long").alias("delta_bytes"), F.lit("decision for unknown or inactive note").alias("detail"))
    return known.unionByName(lost).orderBy("note_id", "path")


def totals(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """One row (projected_bytes, projected_lines, ready) of plan()'s rows and the projected text (text) of the first tier."""
    blocked = (F.col("status") == "BLOCKED") | (F.col("detail") == "archive blocked by active incoming link/stub")
    size = memory.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("projected_bytes"), F.coalesce(F.sum(F.size(lines_of(F.col("text")))), F.lit(0)).cast("long").alias("projected_lines"))
    good = rows.agg(F.coalesce(F.bool_and(~blocked), F.lit(True)).alias("good"))
    fits = (F.col("projected_bytes") <= MOST_BYTES) & (F.col("projected_lines") <= MOST_LINES)
    return size.join(F.broadcast(good)).select("projected_bytes", "projected_lines", (F.col("good") & fits).alias("ready"))  # one row each


def edited(text: Column, edits: Column) -> Column:
    """A text with the edits (start, stop, replacement) made, from right to left; they do not overlap."""
    ordered = F.reverse(F.array_sort(edits))
    put = lambda t, e: F.concat(F.left(t, e["start"]), e["replacement"], F.substring(t, e["stop"] + 1, F.length(t)))
    return F.aggregate(ordered, text, put)


def report(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """One row (report): the plan as JSON, keys sorted, rows in order."""
    row = F.struct("confidence", "delta_bytes", "detail", "note_id", "path", "status", "target_path")
    order = F.struct(F.col("note_id").alias("a"), F.col("path").alias("b"), row.alias("row"))
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["row"]).alias("rows"))  # a report holds all notes of a corpus that fits MOST_BYTES
    made = sums.join(F.broadcast(listed)).select(F.struct(F.col("projected_bytes").alias("projected_l2_bytes"), F.col("projected_lines").alias("projected_l2_lines"), "ready", "rows").alias("r"))  # one row each
    return made.select(F.to_json("r", {"ignoreNullFields": "false"}).alias("report"))
