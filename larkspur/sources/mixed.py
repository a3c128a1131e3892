"""Records of folders that mix JSON, JSON lines and separated values, each file by its own signs.

Lines are read by Spark's text reader, so large files of lines are split by byte ranges and any
store that Spark opens will do.  One pass tells for each file what it is and which sign parts its
cells; only files that are one JSON value over several lines are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.text import is_json
from larkspur.sources.files import WRAPPERS

# Signs that may part cells, the first wins a tie.
SIGNS = [",", ";", "\t", "|"]


def _lines(spark: SparkSession, path: str, only: str | None) -> DataFrame:
    """(file, at, value) of every line; at sorts a file's lines."""
    reader = spark.read.option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", only) if only else reader).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def cells(line: Column, sign: Column) -> Column:
    """The cells of a line; a sign within double quotes parts nothing, and doubled quotes are one."""
    escaped = F.concat(F.lit("[" ), sign, F.lit("]"))
    parts = F.split(line, F.concat(escaped, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')), -1)
    bare = lambda c: F.when(F.trim(c).rlike(r'(?s)^".*"$'), F.replace(F.regexp_replace(F.trim(c), r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(parts, bare)


def kinds_of_files(lines: DataFrame) -> DataFrame:
    """(file, kind, head_at, sign, names) of (file, at, value): json, jsonl or csv by a file's first line that is not blank and by whether all lines are JSON."""
    said = lines.where(F.trim("value") != "")
    value = F.regexp_replace("value", "^﻿", "")
    per = said.groupBy("file").agg(F.min("at").alias("head_at"), F.min_by(value, "at").alias("head"), F.count("*").alias("n"), F.count_if(is_json(value)).alias("good"))
    json = F.ltrim("head").rlike(r"^[\[{]")
    kind = F.when(json & (F.col("n") == F.col("good")) & (F.col("n") > 1), "jsonl").when(json, "json").otherwise("csv")
    counts = [F.length("head") - F.length(F.replace("head", F.lit(s), F.lit(""))) for s in SIGNS]
    sign = F.element_at(F.array(*[F.lit(s) for s in SIGNS]), F.array_position(F.array(*counts), F.greatest(*counts)).cast("int"))
    out = per.withColumn("kind", kind).withColumn("sign", F.when(F.col("kind") == "csv", sign))
    names = F.when(F.col("kind") == "csv", F.transform(cells(F.col("head"), F.col("sign")), lambda c: F.trim(c)))
    return out.select("file", "kind", "head_at", "sign", names.alias("names"))


def records_of(value: Column, schema: StructType) -> Column:
    """The records of a JSON value: a list, an object that holds one under a known name, or one record."""
    many, one = f"array<{schema.simpleString()}>", schema.simpleString()
    held = [F.from_json(F.get_json_object(value, f"$.{w}"), many) for w in WRAPPERS]
    start = lambda text: F.startswith(F.ltrim(text), F.lit("["))
    wrapped = [F.when(start(F.get_json_object(value, f"$.{w}")), h) for w, h in zip(WRAPPERS, held)]
    return F.when(start(value), F.from_json(value, many)).otherwise(F.coalesce(*wrapped, F.array(F.from_json(value, one))))


def read_mixed(spark: SparkSession, path: str, schema: str, only: str | None = None) -> DataFrame:
    """(file, kind, place, fields of schema) of all records below a folder; place sorts a file's records.

    Cells are matched by the names in a file's first line and cast, null where that fails or the file has
    no such name.  Lines that are blank, or in a file of JSON lines hold no object, give no
    record; a file that begins like JSON but is none gives none; empty files none.  ``only``
    is a pattern of file names.
    """
    fields = StructType.fromDDL(schema)
    lines = _lines(spark, path, only)
    kinds = kinds_of_files(lines)
    rows = lines.join(kinds.where("kind <> 'json'"), "file").where(F.trim("value") != "")
    place = lambda inner: F.struct(F.col("at.block").alias("block"), F.col("at.line").alias("line"), inner.cast("int").alias("item"))
    names = [f.name for f in fields]
    made = rows.where("kind = 'csv' and at > head_at").withColumn("cells", cells(F.col("value"), F.col("sign")))
    pick = lambda f: F.get("cells", F.array_position("names", f.name).cast("int") - 1)
    made = made.select("file", "kind", place(F.lit(0)).alias("place"), *[F.when(F.array_contains("names", f.name), pick(f)).try_cast(f.dataType).alias(f.name) for f in fields])
    objects = rows.where("kind = 'jsonl'").withColumn("r", F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.from_json("value", fields)))
    objects = objects.where("r is not null").select("file", "kind", place(F.lit(0)).alias("place"), *[F.col(f"r.{n}").alias(n) for n in names])
    whole = [r.file for r in kinds.where("kind = 'json'").select("file").collect()]  # names of files, as Spark's own listing holds them
    out = made.unionByName(objects)
    if whole:
        values = spark.read.text([_unescaped(w) for w in whole], wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value")).where(is_json(F.col("value")))
        held = values.select("file", F.posexplode(records_of(F.col("value"), fields)).alias("item", "r")).where("r is not null")
        at = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), F.col("item"))
        out = out.unionByName(held.select("file", F.lit("json").alias("kind"), at.alias("place"), *[F.col(f"r.{n}").alias(n) for n in names]))
    return out


def _unescaped(uri: str) -> str:
    """A file's path from the form that _metadata gives."""
    from urllib.parse import unquote

    return unquote(uri)


def first_of_ids(records: DataFrame, key: str = "id") -> DataFrame:
    """Of records with the same id the first by file and place; those without an id stay."""
    best = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*records.columns), F.struct("file", "place")).alias("r")).select("r.*")
    return best.unionByName(records.where(F.col(key).isNull()))
