"""Digests of JSON texts: long strings and arrays are cut, and what is cut is kept under a reference.

Texts are VARIANT values that are taken apart level by level: each level is a table of
nodes, its children the next.  Long arrays are profiled field by field over all their items;
only their first items go on to the next level.  Then texts are put together again from the
deepest level up.  Fields come in order of their names, as VARIANT holds them; a text in
which an object repeats a name is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import is_json
from larkspur.operators.links import checkpointed
from larkspur.operators.profile import json_kind

# What a digest keeps, and the words it uses.
SAMPLES, LONG_ARRAY, LONG_TEXT, DEPTH, FEW = 2, 5, 240, 12, 12
TOO_DEEP = "<depth-limit>"

NODE = ["row", "at"]  # at holds a node's position at each level, so it sorts as the text is written


def quoted(text: Column) -> Column:
    """A string as JSON."""
    made = F.to_json(F.struct(text.alias("x")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def read_json(rows: DataFrame) -> DataFrame:
    """(row, id, kind, v) of (id, text): one JSON value, or the array of its lines' values (kind jsonl); kind and v are null where it is neither."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole, each = F.when(is_json(F.col("text")), F.try_parse_json("text")), (F.size(lines) > 0) & F.forall(lines, is_json)
    v = F.coalesce(whole, F.try_parse_json(F.when(each, F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")))))
    kind = F.when(whole.isNotNull(), "json").when(v.isNotNull(), "jsonl")
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "id", kind.alias("kind"), v.alias("v")))


def _nodes(level: DataFrame) -> DataFrame:
    """What each node of (row, at, key, v, plain) is: its kind, items, mix (what a long array holds), cut (S or J), and leaf, its text if that is all of it."""
    kind = json_kind(F.col("v"))
    items = F.when(kind == "array", F.try_variant_get("v", "$", "array<variant>"))
    named = level.withColumn("kind", kind).withColumn("deep", F.size("at") > DEPTH).withColumn("n", F.size(items))
    long = (F.col("kind") == "array") & (F.col("n") >= LONG_ARRAY) & ~F.col("deep")
    kinds = F.when(long, F.array_sort(F.array_distinct(F.transform(items, json_kind))))
    named = named.withColumn("kinds", kinds).withColumn("word", F.when(F.col("kind") == "str", F.try_variant_get("v", "$", "string")))
    mix = F.when(F.col("kinds").isNull(), None).when(F.col("kinds") == F.array(F.lit("object")), "object").when(F.arrays_overlap("kinds", F.array(F.lit("object"), F.lit("array"))), "mixed").otherwise("scalar")
    cut = F.when(long, "J").when((F.length("word") > LONG_TEXT) & ~F.col("plain") & ~F.col("deep"), "S")
    leaf = F.when(F.col("deep"), quoted(F.lit(TOO_DEEP))).when(~F.col("kind").isin("object", "array"), F.to_json("v"))
    return named.withColumn("mix", mix).withColumn("cut", cut).withColumn("leaf", leaf)


def _children(nodes: DataFrame) -> DataFrame:
    inner = nodes.where("leaf is null")
    parts = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("child", "name", "inner"))
    parts = parts.where((F.col("cut").isNull()) | (F.col("child") < SAMPLES))
    return parts.select("row", F.concat("at", F.array("child")).alias("at"), F.col("name").alias("key"), F.col("inner").alias("v"), F.coalesce(F.col("mix") == "scalar", F.lit(False)).alias("plain"))


def field_profiles(arrays: DataFrame) -> DataFrame:
    """(row, at, field, types, nulls, missing, unique, values, low, high, shortest, longest, sample, profile) of each long array (row, at, v, n, mix) of objects, by field, or of scalars, field null.

    values are given, as JSON, where there are at most FEW, low and high of more numbers,
    lengths and a sample of more strings; profile is all of it as JSON.
    """
    explode = lambda rows, column, names: rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer()).toDF(*names))
    items = explode(arrays.where("mix <> 'mixed'"), "v", ["pos", "no_name", "item"])
    fields = explode(items.where("mix = 'object'"), "item", ["no_pos", "field", "value"]).select(*NODE, "n", "field", "pos", "value")
    cells = fields.unionByName(items.where("mix = 'scalar'").select(*NODE, "n", F.lit(None).cast("string").alias("field"), "pos", F.col("item").alias("value")))
    kind = json_kind(F.col("value"))
    cells = cells.select(*NODE, "n", "field", "pos", kind.alias("kind"), F.when(kind.isin("int", "float", "str", "bool"), F.to_json("value")).alias("json"), F.when(kind == "str", F.try_variant_get("value", "$", "string")).alias("word"))
    each = cells.groupBy(*NODE, "n", "field", "kind", "json", "word").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    real, number = F.col("kind") != "null", F.when(F.col("kind").isin("int", "float"), F.col("json").cast("double"))
    per = each.groupBy(*NODE, "n", "field").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("kind")))), "|").alias("types"), F.sum("times").alias("present"), F.coalesce(F.sum(F.when(real, F.col("times"))), F.lit(0)).alias("filled"),
        F.count_if(real).alias("unique"), F.count_if(F.col("kind").isin("object", "array")).alias("nested"), F.count(number).alias("numbers"), F.count("word").alias("words"),
        F.array_sort(F.collect_list(F.when(real, F.struct("kind", "json")))).alias("all"), F.min_by("json", number).alias("low"), F.max_by("json", number).alias("high"),
        F.min(F.length("word")).alias("shortest"), F.max(F.length("word")).alias("longest"), F.left(F.min_by("word", F.when(F.col("word").isNotNull(), F.col("pos"))), F.lit(60)).alias("sample"),
    )
    plain = (F.col("nested") == 0) & (F.col("unique") > 0)
    few, many = plain & (F.col("unique") <= FEW), plain & (F.col("unique") > FEW)
    numbers, words = many & (F.col("numbers") == F.col("unique")), many & (F.col("words") == F.col("unique"))
    out = per.select(
        *NODE, "field", F.when(F.col("types") == "", "null").otherwise(F.col("types")).alias("types"), (F.col("n") - F.col("filled")).alias("nulls"), (F.col("n") - F.col("present")).alias("missing"), F.when(plain, F.col("unique")).alias("unique"),
        F.when(few, F.transform("all", lambda x: x["json"])).alias("values"), *[F.when(numbers, F.col(c)).alias(c) for c in ("low", "high")], *[F.when(words, F.col(c)).alias(c) for c in ("shortest", "longest", "sample")],
    )
    said = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    count = lambda name: F.when(F.col(name) > 0, said(name, F.col(name).cast("string")))
    parts = [
        F.concat(F.lit('{"type":'), quoted(F.col("types"))), count("nulls"), count("unique"), said("values", F.concat(F.lit("["), F.array_join("values", ","), F.lit("]"))), said("min", F.col("low")), said("max", F.col("high")),
        said("len", quoted(F.concat_ws("..", F.col("shortest").cast("string"), F.when(F.col("shortest").isNotNull(), F.col("longest").cast("string"))))), said("sample", quoted(F.col("sample"))), count("missing"),
    ]
    parts[6] = F.when(F.col("shortest").isNotNull(), parts[6])
    parts[7] = F.when(F.col("sample").isNotNull(), parts[7])
    return out.withColumn("profile", F.concat(F.concat_ws("", *parts), F.lit("}")))


def cut_nodes(read: DataFrame) -> list[DataFrame]:
    """The nodes of read_json's values, a table for each level that occurs."""
    level = checkpointed(_nodes(read.where("v is not null").select("row", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), "v", F.lit(False).alias("plain"))))
    levels = [level]
    while level.where("leaf is null").take(1):
        level = checkpointed(_nodes(_children(level)))
        levels.append(level)
    return levels


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cut_parts(levels: list[DataFrame]) -> DataFrame:
    """(row, at, ref, payload): what is cut, numbered in each text in the order in which it stands there."""
    cuts = _union(levels).where("cut is not null")
    turn = F.row_number().over(Window.partitionBy("row", "cut").orderBy("at"))
    return cuts.select(*NODE, F.concat("cut", turn.cast("string")).alias("ref"), F.when(F.col("cut") == "S", F.col("word")).otherwise(F.to_json("v")).alias("payload"))


def _folded(levels: list[DataFrame], refs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(row, text): each value's digest as JSON, from the deepest level up."""
    frames = profiles.groupBy(*NODE).agg(F.array_sort(F.collect_list(F.struct("field", "profile"))).alias("frames"))
    text = None
    for nodes in reversed(levels):
        rows = nodes.join(refs.select(*NODE, "ref"), NODE, "left").join(frames, NODE, "left")
        if text is None:
            rows = rows.withColumn("parts", F.array().cast("array<struct<at:array<int>,key:string,text:string>>"))
        else:
            parents = text.groupBy("row", F.slice("at", 1, F.size("at") - 1).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "text"))).alias("parts"))
            rows = rows.join(parents, NODE, "left")
        parts = F.coalesce(F.col("parts"), F.array().cast("array<struct<at:array<int>,key:string,text:string>>"))
        listed = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        named = lambda items, key, value: F.concat(F.lit("{"), F.array_join(F.transform(items, lambda p: F.concat(quoted(p[key]), F.lit(":"), p[value])), ","), F.lit("}"))
        inner = F.when(F.col("kind") == "object", named(parts, "key", "text")).otherwise(listed(F.transform(parts, lambda p: p["text"])))
        what = F.when(F.col("mix") == "object", F.concat(F.lit('"schema":'), F.coalesce(named(F.col("frames"), "field", "profile"), F.lit("{}")))).when(F.col("mix") == "scalar", F.concat(F.lit('"profile":'), F.get("frames", F.lit(0))["profile"])).otherwise(F.concat(F.lit('"types":'), F.to_json("kinds")))
        array = F.concat(F.lit('{"__crushed":'), quoted(F.concat(F.lit("array<"), "mix", F.lit(">["), F.col("n").cast("string"), F.lit("]"))), F.lit(',"ref":'), quoted(F.col("ref")), F.lit(","), what, F.lit(',"samples":'), inner, F.lit("}"))
        short = quoted(F.concat(F.left("word", F.lit(LONG_TEXT)), F.lit("... <+"), (F.length("word") - LONG_TEXT).cast("string"), F.lit(" chars ref="), "ref", F.lit(">")))
        told = F.when(F.col("cut") == "S", short).when(F.col("cut") == "J", array).otherwise(F.coalesce("leaf", inner))
        text = rows.select("row", "at", "key", told.alias("text"))
    return text.select("row", "text")


def json_digest(rows: DataFrame) -> DataFrame:
    """(id, kind, digest, kept) of (id, text): the digest as JSON and a map from references to what was cut; kind and digest are null where a text is neither JSON nor JSON lines."""
    read = read_json(rows)
    levels = cut_nodes(read)
    refs = checkpointed(cut_parts(levels))
    profiles = checkpointed(field_profiles(_union(levels).where("cut = 'J'")))
    kept = refs.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "payload")))).alias("kept"))
    out = read.drop("v").join(_folded(levels, refs, profiles), "row", "left").join(kept, "row", "left")
    return out.select("id", "kind", F.col("text").alias("digest"), F.coalesce("kept", F.expr("cast(map() as map<string, string>)")).alias("kept"))


def json_fields(rows: DataFrame) -> DataFrame:
    """(id, ref, field, types, nulls, missing, unique, values, low, high, shortest, longest, sample) of (id, text): the fields of every array that the digests cut."""
    read = read_json(rows)
    levels = cut_nodes(read)
    profiles = field_profiles(_union(levels).where("cut = 'J'")).drop("profile")
    return profiles.join(cut_parts(levels).select(*NODE, "ref"), NODE).join(read.select("row", "id"), "row").drop(*NODE)


def kept_parts(digests: DataFrame) -> DataFrame:
    """(id, ref, payload): what the digests cut, one row each, to be written and looked up."""
    return digests.select("id", F.explode("kept").alias("ref", "payload"))


def read_back(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, ref, asked, payload) of kept parts and a log of requests (id, ref): how often each was asked for, and what it is, null if there is none."""
    hits = asked.groupBy("id", "ref").agg(F.count("*").alias("asked"))
    return hits.join(parts, ["id", "ref"], "left").select("id", "ref", "asked", "payload")
