"""Handoff snapshots: parsing, validation, expiry, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import clip, lines_of, secrets

# What a snapshot must have.
SCHEMA = "handoff/1"
MOST_BYTES = 32 * 1024
META = ["schema", "created", "expires", "status", "source", "sensitive_reviewed"]
STATUS = ["DRAFT", "REVIEWED"]
SECTIONS = ["Objective", "Verified", "Unverified", "Decisions", "Failures", "Artifacts", "Next Action", "Resume Guard"]
GUARD = {"paths": ("path", "exist"), "time": ("time", "revalid"), "authority": ("current", "instruction"), "evidence": ("proven", "re-check")}
ACTION = ["Do", "Needs", "Expect"]

FRONT = r"(?s)\A---\n(.*?)\n---\n"
BULLET = r"^\s*-\s+.*\S\s*$"


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text)), "yyyy-MM-dd")


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) structs; of equal keys the last stands."""
    return F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


def parse(files: DataFrame) -> DataFrame:
    """Adds has_front, keys (in order, repeats kept), meta, sections and order (headings) to (path, text)."""
    front = F.regexp_extract("text", FRONT, 1)
    has = F.col("text").rlike(FRONT)
    lines = F.filter(F.when(has, lines_of(front)).otherwise(F.array().cast("array<string>")), lambda line: F.contains(line, F.lit(":")))
    pair = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))
    pairs = F.transform(lines, pair)
    body = F.when(has, F.regexp_replace("text", FRONT, "")).otherwise(F.col("text"))
    parts = F.filter(F.split(body, r"(?m)(?=^## [^\n]*\S)"), lambda p: p.rlike(r"^## [^\n]*\S"))
    name = lambda p: F.trim(F.regexp_extract(p, r"^## ([^\n]*)", 1))
    inner = lambda p: F.regexp_replace(F.regexp_replace(p, r"^## [^\n]*", ""), r"^\s+|\s+$", "")
    sections = F.transform(parts, lambda p: F.struct(name(p).alias("key"), inner(p).alias("value")))
    return files.select("*", has.alias("has_front"), F.transform(pairs, lambda p: p["key"]).alias("keys"), _last_wins(pairs).alias("meta"), _last_wins(sections).alias("sections"), F.transform(parts, name).alias("order"))


def expired(meta: Column, today: Column) -> Column:
    """Whether the day a snapshot expires lies before today; false if it names none."""
    return F.coalesce(iso_date(F.try_element_at(meta, F.lit("expires"))) < today, F.lit(False))


def validate(parsed: DataFrame, today: Column) -> DataFrame:
    """Findings (path, level, code, detail) of parse()'s rows; a snapshot with a FAIL is not to be kept."""
    empty = F.array().cast("array<string>")
    get = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    part = lambda k: F.coalesce(F.try_element_at("sections", F.lit(k)), F.lit(""))
    filled = lambda k: F.filter(F.split(part(k), "\n"), lambda line: F.trim(line) != "")
    bare = lambda line: F.trim(F.regexp_replace(line, r"^\s*-\s+", ""))
    named = F.array(*[F.lit(s) for s in SECTIONS])
    twice = F.array_sort(F.array_distinct(F.filter("keys", lambda k: F.size(F.filter("keys", lambda x: x == k)) > 1)))
    unknown = F.array_sort(F.array_except("order", named))
    there = F.filter(named, lambda s: F.array_contains(F.map_keys("sections"), s))
    created, expires = iso_date(get("created")), iso_date(get("expires"))
    asked = filled("Next Action")
    label = lambda line: F.trim(F.regexp_extract(line, r"^\s*-\s+\*\*([^*]+):\*\*\s*\S.*$", 1))
    labels = F.transform(asked, label)
    action_bad = F.exists(labels, lambda k: k == "") | (F.size(labels) != F.size(F.array_distinct(labels))) | (F.array_sort(F.array_distinct(labels)) != F.array_sort(F.array(*[F.lit(a) for a in ACTION])))
    rules_ = filled("Resume Guard")
    guard_bad = (F.size(rules_) == 0) | F.exists(rules_, lambda line: ~line.rlike(BULLET))
    says = lambda one, two: lambda b: F.contains(b, F.lit(one)) & F.contains(b, F.lit(two))
    low = F.transform(rules_, lambda line: F.lower(bare(line)))
    lacking = F.filter(F.array(*[F.when(~F.exists(low, says(*terms)), rule) for rule, terms in GUARD.items()]), lambda x: x.isNotNull())

    def one(condition, level, code, detail=None):
        return F.when(condition, F.array(F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail")))).otherwise(F.expr("cast(array() as array<struct<level:string,code:string,detail:string>>)"))

    def each(items, level, code):
        return F.transform(items, lambda x: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), x.alias("detail")))

    def marked(section, code, marker):
        lines = F.when(F.lower(part(section)) == "(none)", empty).otherwise(filled(section))
        odd = F.filter(lines, lambda line: ~line.rlike(BULLET))
        return [one(F.size(odd) > 0, "FAIL", "F015", F.concat(F.lit(f"{section}: "), clip(F.get(odd, 0)))), each(F.transform(F.filter(lines, lambda line: ~bare(line).rlike(rf"\*\*{marker}:\*\*\s*\S")), lambda line: clip(bare(line))), "FAIL", code)]

    found = [
        one(F.octet_length("text") > MOST_BYTES, "FAIL", "F009"), one(~F.col("has_front"), "FAIL", "F001"), one(F.size(twice) > 0, "FAIL", "F016", F.array_join(twice, ", ")),
        each(F.filter(F.array(*[F.when(get(k) == "", F.lit(k)) for k in META]), lambda k: k.isNotNull()), "FAIL", "F002"),
        one((get("schema") != "") & (get("schema") != SCHEMA), "FAIL", "F003", get("schema")), one((get("status") != "") & ~get("status").isin(STATUS), "FAIL", "F013", get("status")),
        one(F.size(unknown) > 0, "FAIL", "F017", F.array_join(unknown, ", ")), each(F.array_except(named, F.map_keys("sections")), "FAIL", "F004"),
        one(F.filter("order", lambda h: F.array_contains(named, h)) != there, "FAIL", "F005"),
        one((get("created") != "") & created.isNull(), "FAIL", "F014", F.lit("created")), one((get("expires") != "") & expires.isNull(), "FAIL", "F014", F.lit("expires")),
        one(expires < created, "FAIL", "F010"), one((expires >= created) & (expires < today), "WARN", "W002", expires.cast("string")),
        *marked("Verified", "F011", "Evidence"), *marked("Decisions", "F012", "Why"),
        one(action_bad, "FAIL", "F006"), one(guard_bad, "FAIL", "F007"), one(~guard_bad & (F.size(lacking) > 0), "FAIL", "F007", F.array_join(lacking, ", ")),
        each(secrets(F.col("text")), "FAIL", "F008"),
        one(get("status") == "DRAFT", "WARN", "W001"), one(~F.lower(get("sensitive_reviewed")).isin("yes", "true"), "WARN", "W003"),
    ]
    return parsed.select("path", F.explode(F.concat(*found)).alias("f")).select("path", "f.level", "f.code", "f.detail")


def inventory(parsed: DataFrame, today: Column) -> DataFrame:
    """(path, age_days, expires, state) of each snapshot: EXPIRED, or its status."""
    get = lambda k: F.try_element_at("meta", F.lit(k))
    state = F.when(expired(F.col("meta"), today), "EXPIRED").otherwise(F.coalesce(F.nullif(get("status"), F.lit("")), F.lit("?")))
    return parsed.select("path", F.datediff(today, iso_date(get("created"))).alias("age_days"), F.coalesce(get("expires"), F.lit("?")).alias("expires"), state.alias("state"))
