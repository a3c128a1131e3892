"""Markdown notes as records: parsing, audit, scoring, index, evidence."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import access_recency, note_action, utility
from larkspur.functions.text import escape_cell, lines_of, offsets, secret_hits, secrets

# What an audited note may hold.
CONFIDENCE = ["VERIFIED", "HIGH", "MEDIUM", "LOW"]
TYPES = ["Failure-Mode", "Gotcha", "Decision", "Preference", "Environment-Invariant", "Domain-Fact"]
REQUIRED = ["Type", "Confidence", "Salience", "Created", "Last-Access", "Freq", "Tags", "Links", "Provenance", "Observation", "Directive"]
STANCES = ["SUPPORT", "CHALLENGE"]
MOST_EVIDENCE, MOST_SOURCE, MOST_QUOTE, MOST_NOTES = 16, 240, 280, 12

ID = r"MEM-\d{4}-\d{4}"


def date_of(text: Column) -> Column:
    """An ISO date, null if it is none."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text), "y-M-d")


def parse_notes(files: DataFrame) -> DataFrame:
    """One row per ``### [MEM-...]`` section of (path, text): pos, id, title, body, fields, stub, links, tags.

    A body ends before the next note or second-level heading; of fields with the
    same name the last counts.
    """
    parts = files.select("path", F.posexplode(F.split("text", rf"(?m)(?=^### \[{ID}\])")).alias("pos", "part"))
    parts = parts.where(F.col("part").rlike(rf"^### \[{ID}\]\s+\S"))
    body = F.element_at(F.split(F.regexp_replace("part", r"^[^\n]*", ""), r"\n## ", 2), 1)
    notes = parts.select("path", "pos", F.regexp_extract("part", rf"^### \[({ID})\]", 1).alias("id"), F.trim(F.regexp_extract("part", rf"^### \[{ID}\]\s+([^\n]+)", 1)).alias("title"), body.alias("body"))
    field = r"\*\*([A-Za-z-]+)(?:\s*\([^)]*\))?:\*\*[ \t]*([^\n·]*)"
    names, values = F.regexp_extract_all("body", F.lit(field), F.lit(1)), F.regexp_extract_all("body", F.lit(field), F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(v).alias("value")))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p.key), F.create_map(p.key, p.value)))
    notes = notes.withColumn("fields", last).withColumn("stub", F.col("body").rlike(r"(?m)^\s*-\s+\*\*Stub\.\*\*"))
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    return notes.withColumn("links", F.regexp_extract_all(get("Links"), F.lit(rf"\[\[({ID})\]\]"), F.lit(1))).withColumn("tags", F.regexp_extract_all(get("Tags"), F.lit(r"#[\w-]+"), F.lit(0)))


def audit_notes(notes: DataFrame, today: Column) -> DataFrame:
    """Findings (level, subject, rule) of all notes; a note with none is fine."""
    get = lambda k: F.trim(F.try_element_at("fields", F.lit(k)))
    salience, freq = get("Salience").try_cast("double"), get("Freq").try_cast("long")
    created, access = date_of(get("Created")), date_of(get("Last-Access"))
    full = ~F.col("stub")
    rules = [
        (full & ~F.coalesce(get("Confidence"), F.lit("")).isin(CONFIDENCE), "FAIL", "confidence"),
        (full & ~F.coalesce(get("Type"), F.lit("")).isin(TYPES), "FAIL", "type"),
        (full & ~F.coalesce(salience.between(0, 1), F.lit(False)), "FAIL", "salience"),
        (full & ~F.coalesce(freq >= 0, F.lit(False)), "FAIL", "freq"),
        (full & (created.isNull() | access.isNull()), "FAIL", "date"),
        (full & F.coalesce((created > today) | (access > today), F.lit(False)), "FAIL", "future date"),
        (full & F.coalesce(access < created, F.lit(False)), "FAIL", "access before creation"),
        (full & (F.size("tags") == 0), "WARN", "tags"),
        (F.size(secrets(F.col("body"))) > 0, "FAIL", "secret"),
        (F.col("stub") & ~F.col("body").rlike(r"Memory/[\w./-]+\.md"), "FAIL", "stub path"),
        *[(full & (F.coalesce(get(k), F.lit("")) == ""), "FAIL", f"missing {k}") for k in REQUIRED],
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for c, level, rule in rules]), lambda x: x.isNotNull())
    own = notes.select(F.col("id").alias("subject"), F.explode(found).alias("f")).select("f.level", "subject", "f.rule")
    twice = notes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("FAIL").alias("level"), F.col("id").alias("subject"), F.lit("duplicate id").alias("rule"))
    links = notes.select("id", F.explode("links").alias("link"))
    lost = links.join(notes.select(F.col("id").alias("link")), "link", "left_anti").select(F.lit("FAIL").alias("level"), F.col("id").alias("subject"), F.concat(F.lit("unresolved "), "link").alias("rule"))
    many = notes.agg(F.count("*").alias("n")).where((F.col("n") > MOST_NOTES) | (F.col("n") == 0)).select(F.lit("FAIL").alias("level"), F.lit("all").alias("subject"), F.lit("occupancy").alias("rule"))
    return own.unionByName(twice).unionByName(lost).unionByName(many)


def score_notes(notes: DataFrame, today: Column) -> DataFrame:
    """(id, recency, utility, score, action) from id, last_access, created, freq, importance, stub; best first, ties by pos or id."""
    r = access_recency(F.col("last_access"), today)
    u = utility(F.col("freq"), F.col("importance"), F.greatest(F.lit(0), F.datediff(today, F.col("last_access"))))
    out = notes.withColumn("recency", r).withColumn("utility", u).withColumn("score", 0.25 * F.col("recency") + F.lit(Decimal("0.35")) * F.col("importance") + 0.40 * 0.5)
    out = out.withColumn("action", note_action(F.col("stub"), F.col("utility"), F.col("importance")))
    return out.orderBy(F.desc(F.round("score", 12)), "pos" if "pos" in notes.columns else "id")


def tag_index(notes: DataFrame) -> DataFrame:
    """(tag, ids): the last four characters of the ids under each tag, sorted."""
    return notes.select(F.explode("tags").alias("tag"), F.right("id", F.lit(4)).alias("id")).groupBy("tag").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def canonical(date: Column, stance: Column, source: Column, quote: Column) -> Column:
    """Canonical JSON of an evidence record; control characters are escaped in lower case."""
    text = F.to_json(F.struct(date.alias("date"), stance.alias("stance"), source.alias("source"), quote.alias("quote")))
    for digit in "ABCDEF":
        # an escape follows an even number of backslashes
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return text


def inspect_evidence(lines: DataFrame, today: Column) -> DataFrame:
    """Each ``- **Evidence:** {json}`` line of (note_id, line_no, raw) with its fields, fingerprint and first fault."""
    prefix = "- **Evidence:** "
    labelled = lines.where(F.col("raw").contains("**Evidence:**"))
    payload = F.when(F.startswith("raw", F.lit(prefix)), F.substring("raw", len(prefix) + 1, 1 << 20))
    p = labelled.withColumn("payload", payload).withColumn("j", F.from_json("payload", "date string, stance string, source string, quote string"))
    p = p.withColumn("canonical", canonical(F.trim("j.date"), F.trim("j.stance"), F.trim("j.source"), F.trim("j.quote")))
    p = p.withColumn("day", date_of(F.trim("j.date"))).withColumn("fingerprint", F.sha2("canonical", 256))
    p = p.withColumn("turn", F.row_number().over(Window.partitionBy("note_id", "fingerprint").orderBy("line_no"))).withColumn("number", F.row_number().over(Window.partitionBy("note_id").orderBy("line_no")))
    fault = (
        F.when(F.col("payload").isNull() | F.col("j").isNull() | F.col("j.stance").isNull() | F.col("j.source").isNull() | F.col("j.quote").isNull(), "malformed")
        .when(F.col("day").isNull(), "date").when(F.col("day") > today, "future date")
        .when(~F.col("j.stance").isin(STANCES), "stance")
        .when((F.trim("j.source") == "") | (F.length("j.source") > MOST_SOURCE), "source")
        .when((F.trim("j.quote") == "") | (F.length("j.quote") > MOST_QUOTE), "quote")
        .when(F.size(secrets(F.col("payload"))) > 0, "secret")
        .when(F.col("payload") != F.col("canonical"), "not canonical")
        .when(F.col("turn") > 1, "duplicate")
        .when(F.col("number") > MOST_EVIDENCE, "too many")
    )
    return p.select("note_id", "line_no", "day", "j.stance", "j.source", "j.quote", "canonical", "fingerprint", fault.alias("fault"))


def evidence_report(inspected: DataFrame) -> DataFrame:
    """Per note: support, challenge, contested; only lines without fault count."""
    good = F.col("fault").isNull()
    return inspected.groupBy("note_id").agg(F.count_if(good & (F.col("stance") == "SUPPORT")).alias("support"), F.count_if(good & (F.col("stance") == "CHALLENGE")).alias("challenge"), F.count_if(~good).alias("faults")).withColumn("contested", F.col("challenge") > 0)


def note_spans(files: DataFrame) -> DataFrame:
    """(path, id, pos, start, body_start, stop) of each note of (path, text), in characters.

    A note starts at its heading and stops at the next one, or at a second-level heading
    in its body before that.
    """
    heads = files.select("path", "text", offsets(F.col("text"), rf"(?m)^### \[{ID}\][ \t]+\S[^\n]*$").alias("heads"))

    def span(h, pos):
        begin = h["start"] + F.length(h["match"])
        end = F.coalesce(F.get("heads", pos + 1)["start"], F.length("text"))
        cut = F.instr(F.substring(F.col("text"), begin + 1, end - begin), "\n## ")
        return F.struct(F.regexp_extract(h["match"], f"({ID})", 1).alias("id"), pos.alias("pos"), h["start"].alias("start"), begin.alias("body_start"), F.when(cut > 0, begin + cut - 1).otherwise(end).alias("stop"))

    # within each file, so its text is held once and not once for each note
    return heads.select("path", F.explode(F.transform("heads", span)).alias("s")).select("path", "s.*")


def attributed_secrets(files: DataFrame) -> DataFrame:
    """(path, subject, label, fingerprint): each different credential in (path, text), under the note whose span holds it or else the file."""
    hits = files.select("path", F.explode(secret_hits(F.col("text"))).alias("h")).select("path", "h.label", "h.start", F.sha2("h.match", 256).alias("fingerprint"))
    spans = note_spans(files).select(F.col("path").alias("in"), "id", F.col("start").alias("from"), "stop")
    held = hits.join(spans, (hits["path"] == spans["in"]) & (hits["start"] >= spans["from"]) & (hits["start"] < spans["stop"]), "left")
    return held.select("path", F.coalesce("id", "path").alias("subject"), "label", "fingerprint").distinct()


def file_caps(files: DataFrame, lines: int, size: int) -> DataFrame:
    """(path, lines, bytes, level): FAIL where a file has more lines or bytes than it may."""
    out = files.select("path", F.size(lines_of(F.col("text"))).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"))
    return out.withColumn("level", F.when((F.col("lines") > lines) | (F.col("bytes") > size), "FAIL").otherwise("PASS"))


def counters(notes: DataFrame, year: int) -> DataFrame:
    """One row of (id, action): the next id, how many notes there are, and how many may go."""
    most = F.coalesce(F.max(F.right("id", F.lit(4)).cast("int")), F.lit(0))
    return notes.agg(F.concat(F.lit(f"MEM-{year}-"), F.lpad((most + 1).cast("string"), 4, "0")).alias("next_id"), F.count("*").alias("occupancy"), F.count_if(~F.col("action").isin("KEEP", "STUB")).alias("prune"))


def index_lines(notes: DataFrame) -> DataFrame:
    """(pos, line): the registry's table row of each note (pos, id, title, type, confidence, importance, score, utility, action, support, challenge, links)."""
    cell = lambda c: F.coalesce(F.nullif(escape_cell(F.col(c)), F.lit("")), F.lit("?"))
    counts = F.coalesce(F.concat_ws("/", F.col("support").cast("string"), F.when(F.col("support").isNotNull(), F.col("challenge").cast("string"))), F.lit("-"))
    links = F.coalesce(F.nullif(F.array_join(F.transform("links", lambda x: F.right(x, F.lit(4))), ", "), F.lit("")), F.lit("-"))
    cells = [F.col("id"), escape_cell(F.col("title")), cell("type"), cell("confidence"), F.format_string("%.2f", "importance"), F.format_string("%.3f", "score"), F.format_string("%.3f", "utility"), F.col("action"), F.coalesce(F.nullif(counts, F.lit("")), F.lit("-")), links]
    return notes.select("pos", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def appended(notes: DataFrame, today: Column) -> DataFrame:
    """(note_id, updated, reject) of (note_id, body, date, stance, source, quote): the body with one more evidence line, or why not."""
    trimmed = {c: F.trim(c) for c in ("date", "stance", "source", "quote")}
    line = F.concat(F.lit("- **Evidence:** "), canonical(*trimmed.values()), F.lit("\n"))
    day = date_of(trimmed["date"])
    broken = F.lit(False)
    for c in trimmed:
        broken = broken | F.col(c).rlike(r"[\r\n]")
    reject = (
        F.when(F.col("date").isNull() | F.col("stance").isNull() | F.col("source").isNull() | F.col("quote").isNull(), "keys")
        .when(broken, "newline").when(day.isNull(), "date").when(day > today, "future date").when(~trimmed["stance"].isin(STANCES), "stance")
        .when((trimmed["source"] == "") | (F.length(trimmed["source"]) > MOST_SOURCE), "source")
        .when((trimmed["quote"] == "") | (F.length(trimmed["quote"]) > MOST_QUOTE), "quote")
        .when((F.size(secrets(trimmed["source"])) > 0) | (F.size(secrets(trimmed["quote"])) > 0), "secret")
        .when(F.contains("body", F.rtrim(line, F.lit("\n"))), "duplicate")
        .when(F.regexp_count("body", F.lit(r"(?m)^[ \t]*-[ \t]*\*\*Evidence:\*\*")) >= MOST_EVIDENCE, "too many")
        .when((trimmed["stance"] != "SUPPORT") & ~F.contains("body", F.lit('"stance":"SUPPORT"')), "no support")
    )
    glue = F.when(F.endswith("body", F.lit("\n")), "").otherwise("\n")
    return notes.withColumn("reject", reject).select("note_id", F.when(F.col("reject").isNull(), F.concat("body", glue, line)).alias("updated"), "reject")
