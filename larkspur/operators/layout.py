"""Page layout as records: font sizes, headings, tables, and Markdown of blocks.

Spans have page, y, size, text; blocks kind, text, level, page, y, size, rows; they come from
a reader of page files, which is not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def body_size(spans: DataFrame) -> DataFrame:
    """(doc, body): the font size of most characters of each document, ties to the size met first."""
    sizes = spans.where(F.trim("text") != "").groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("n"), F.min("seq").alias("first"))
    return sizes.groupBy("doc").agg(F.max_by("size", F.struct(F.col("n"), -F.col("first"))).alias("body"))


def heading_scale(spans: DataFrame, bodies: DataFrame, most: int = 4) -> DataFrame:
    """(doc, size, level): the largest font sizes clearly above the body's, the largest is level 1."""
    sizes = spans.where(F.trim("text") != "").select("doc", F.round("size", 1).alias("size")).distinct().join(bodies, "doc").where(F.col("size") > F.col("body") * 1.12)
    level = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size")))
    return sizes.select("doc", "size", level.alias("level")).where(F.col("level") <= most)


def merge_headings(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, seq, kind, level, page, y, size, text) with headings that follow each other closely, on one page and level, as one."""
    w = Window.partitionBy("doc").orderBy("seq")
    gap = F.col("y") - F.lag("y").over(w)
    goes_on = (F.col("kind") == "heading") & (F.lag("kind").over(w) == "heading") & (F.lag("level").over(w) == F.col("level")) & (F.lag("page").over(w) == F.col("page")) & gap.between(F.lit(0.0), 2.0 * F.greatest("size", F.lit(1.0)))
    marked = blocks.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_group", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    out = marked.groupBy("doc", "_group").agg(F.min("seq").alias("seq"), F.first("kind").alias("kind"), F.first("level").alias("level"), F.first("page").alias("page"), F.max("y").alias("y"), parts.alias("p"))
    return out.select("doc", "seq", "kind", "level", "page", "y", F.array_join(F.transform("p", lambda x: F.trim(x["text"])), " ").alias("text"))


def stitched_tables(tables: DataFrame) -> DataFrame:
    """(doc, table, rows) of (doc, page, seq, cols, top, bottom, height, rows): tables that run over a page's end are one.

    A page's first table goes on from the last one of the page before if their columns lie
    within 3 points and it starts in the upper 15 % after one that ends in the lower 20 %.
    Single rows that go on from nothing are no tables.
    """
    w = Window.partitionBy("doc").orderBy("page", "seq")
    same = F.size("cols") == F.size(F.lag("cols").over(w))
    near = same & F.forall(F.zip_with("cols", F.lag("cols").over(w), lambda a, b: F.abs(a - b) < 3), lambda x: F.coalesce(x, F.lit(False)))
    goes_on = near & (F.lag("page").over(w) == F.col("page") - 1) & (F.col("top") < 0.15 * F.col("height")) & (F.lag("bottom").over(w) > 0.80 * F.lag("height").over(w))
    marked = tables.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("table", F.sum("_new").over(w))
    whole = marked.groupBy("doc", "table").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "rows"))), lambda x: x["rows"])).alias("rows"))
    return whole.where(F.size("rows") > 1)


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table: cells escaped, short rows padded, empty ones left out, columns without a head named."""
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    padded = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    head = F.get(padded, 0)
    named = F.when(F.exists(head, lambda c: c != ""), head).otherwise(F.transform(F.sequence(F.lit(1), width), lambda k: F.concat(F.lit("col"), k.cast("string"))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    return F.when(F.size(clean) == 0, "").otherwise(F.array_join(F.concat(F.array(line(named), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)), "\n"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc, text): a document's blocks (doc, seq, kind, level, text, rows) as Markdown; paragraphs that follow each other are one."""
    w = Window.partitionBy("doc").orderBy("seq")
    joins = (F.col("kind") == "para") & (F.lag("kind").over(w) == "para")
    marked = blocks.withColumn("_group", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w))
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "list", F.concat(F.lit("- "), F.col("text")))
        .when(F.col("kind") == "table", markdown_table(F.col("rows")))
        .when(F.col("kind") == "figure", F.concat(F.lit("!["), F.col("text"), F.lit("](#)")))
        .otherwise(F.col("text"))
    )
    parts = marked.withColumn("shown", shown).groupBy("doc", "_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), " ").alias("part"))
    return parts.groupBy("doc").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("_group", "part"))), lambda x: x["part"]), lambda p: F.trim(p) != ""), "\n\n").alias("text"))
