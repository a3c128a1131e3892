"""Readers and writers of text files, trees and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import is_json

# File names that hold no records.
SKIPPED = ["INDEX.md", "INDEX-L3.md", "PROTOCOL.md", "AGENTS.md"]
WRAPPERS = ["botConfigs", "agents", "items", "data", "results"]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of Markdown files, without archives and index files."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").contains("_archive") & ~F.element_at(F.split("path", "/"), -1).isin(SKIPPED))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, content) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")


def read_agents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Agents of JSON files: a list, an object that wraps one, or a record a line; of equal ids the first stays."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("v"))
    lists = [F.from_json("v", f"array<struct<{schema}>>"), *[F.from_json(F.get_json_object("v", f"$.{w}"), f"array<struct<{schema}>>") for w in WRAPPERS]]
    line = F.filter(F.transform(F.split("v", "\n"), lambda x: F.from_json(x, schema)), lambda s: s.isNotNull() & s["id"].isNotNull())
    trimmed = F.ltrim("v")
    found = F.when(F.startswith(trimmed, F.lit("[")), lists[0]).otherwise(F.coalesce(*lists[1:], line))
    rows = raw.select("file", F.posexplode(found).alias("pos", "a")).select("file", "pos", "a.*")
    first = F.row_number().over(Window.partitionBy("id").orderBy("file", "pos"))
    return rows.withColumn("_turn", first).where("_turn = 1").drop("_turn")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): lines of JSON-lines files that do not parse; whole files that are one JSON value have none."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("v")).where(~is_json(F.col("v")))
    lines = raw.select("file", F.posexplode(F.split("v", "\n")).alias("line", "text")).where(F.trim("text") != "")
    return lines.where(~is_json(F.col("text"))).select("file", (F.col("line") + 1).alias("line"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records a line; lines that do not parse are left out, or an error if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(score): the numbers under that name in JSON lines; others are left out."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.score").try_cast("double").alias("score")).where("score is not null")


def read_manifest(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """(name, path) of a JSON object from staged names to real paths; none if it is missing, or an error if it is required."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], "name string, path string")
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "path"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(id, created_at, label, file_count) of snapshot manifests, by id."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "id string, created_at string, label string, files map<string,string>").alias("m"))
    return raw.select("m.id", "m.created_at", F.coalesce("m.label", F.lit("")).alias("label"), F.size("m.files").alias("file_count")).orderBy("id")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Blobs (sha256, content), one for each content, in folders by the first two letters of their hash."""
    blobs.dropDuplicates(["sha256"]).withColumn("prefix", F.left("sha256", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Those columns, in that order, with a header; others are left out."""
    rows.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def sniff_delimiter(head: str) -> str:
    """The most frequent of comma, semicolon, tab and bar in a header line."""
    return max(",;\t|", key=head.count)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.text(path).limit(1).collect()
    return spark.read.csv(path, header=True, sep=sniff_delimiter(head[0][0] if head else ","))


def write_markdown_table(rows: DataFrame, path: str) -> None:
    """Rows as lines of a Markdown table, in their partitions' order; the head is a file of its own, which comes first."""
    from larkspur.functions.text import escape_cell

    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [F.lit(c) for c in rows.columns]
    made = rows.sparkSession.range(1).select(F.explode(F.array(line(head), F.lit("|" + "---|" * len(rows.columns)))).alias("value"))
    made.coalesce(1).write.mode("overwrite").text(f"{path}/head")
    rows.select(line([F.coalesce(escape_cell(F.col(c)), F.lit("")) for c in rows.columns]).alias("value")).write.mode("overwrite").text(f"{path}/rows")


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
