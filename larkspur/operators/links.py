"""Link integrity and dependency graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import lines_of


def dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (id, target) to nodes that do not exist."""
    return links.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("id", "target")


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that no link reaches."""
    return nodes.join(links.select(F.col("target").alias("id")), "id", "left_anti")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where none is set, a session in one process (as in tests) gets a temporary one; on a
    cluster this is an error, as executors do not share local folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows without their lineage, in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = checkpoint_folder(df.sparkSession)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As checkpointed(), as a compressed table in the same folder; for wide rows."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, doublings: int = 32) -> DataFrame:
    """(src, dst): every pair with a path; a node on a cycle reaches itself.

    Each step joins the pairs with themselves, so paths of length n take log2(n)
    steps; it stops when nothing is added.
    """
    reach = checkpointed(edges.select("src", "dst").distinct())
    n = reach.count()
    for _ in range(doublings):
        longer = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        reach = checkpointed(reach.union(longer).distinct())
        was, n = n, reach.count()
        if n == was:
            break
    return reach


def cyclic(reach: DataFrame) -> DataFrame:
    return reach.where("src = dst").select(F.col("src").alias("id"))


def blocked(reach: DataFrame, refuted: DataFrame) -> DataFrame:
    """Descendants of refuted nodes that are not refuted themselves."""
    down = reach.join(refuted.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return down.join(refuted, "id", "left_anti")


def levels(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, ancestors): ordered by it, and id, an acyclic graph is in topological order."""
    above = reach.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("ancestors"))
    return nodes.join(above, "id", "left").select("id", F.coalesce("ancestors", F.lit(0)).cast("long").alias("ancestors"))


def graph_report(claims: DataFrame) -> DataFrame:
    """One row of (id, dependencies): acyclic, cyclic ids, dangling (id, dependency), duplicate ids, and whether all is well."""
    from larkspur.operators.graphs import topology

    deps = claims.select("id", F.explode("dependencies").alias("target"))
    loose = dangling(deps, claims).distinct()
    edges = deps.join(claims.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("src"), F.col("id").alias("dst"))
    rings = topology(claims, edges).where("ring is not null")
    twice = claims.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    parts = [rings.agg(F.array_sort(F.collect_set("id")).alias("cyclic")), loose.agg(F.array_sort(F.collect_set(F.struct("id", "target"))).alias("dangling")), twice.agg(F.array_sort(F.collect_set("id")).alias("duplicates"))]
    out = parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each, findings of a faulty graph
    acyclic = F.size("cyclic") == 0
    return out.select(acyclic.alias("acyclic"), "cyclic", "dangling", "duplicates", (acyclic & (F.size("dangling") == 0) & (F.size("duplicates") == 0)).alias("valid"))


# Files that are no records of their own.
INDEXES = ["/Memory/INDEX.md", "/Memory/PROTOCOL.md", "/Memory/INDEX-L3.md"]
NOTE_ID = r"MEM-\d{4}-\d{4}"
STUB_LINE = r"(?m)^\s*-\s+\*\*Stub\.\*\*"


def own_note(path: Column, text: Column) -> Column:
    """The note id in a file's first heading; null in an archive, in a stub, or without one."""
    heading = F.get(F.filter(F.transform(lines_of(text), lambda line: F.trim(line)), lambda line: F.startswith(line, F.lit("#"))), 0)
    return F.when(~F.contains(path, F.lit("/_archive/")) & ~text.rlike(STUB_LINE), F.nullif(F.regexp_extract(heading, f"({NOTE_ID})", 1), F.lit("")))


def archival(files: DataFrame) -> DataFrame:
    """The files (path, text) of the archival tier: Markdown below /Memory/, but for archives and indexes."""
    return files.where(F.startswith("path", F.lit("/Memory/")) & F.endswith("path", F.lit(".md")) & ~F.contains("path", F.lit("/_archive/")) & ~F.col("path").isin(*INDEXES))


def cross_tier(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (rule, level, subject, target) between notes (id, stub, l3) and files (path, text).

    C1 every path a note names is a file, and a stub names one; C2 links within files are
    notes; C3 ids in names of context files are notes; C4 files that no note names, that
    link no note and that no agents file or index mentions, daily ones apart; C5 a file
    that a note names holds that note's id.
    """
    tier = archival(files).select("path", "text")
    ids = notes.select("id").distinct()
    finding = lambda rows, rule, level, subject, target: rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.alias("subject"), target.alias("target"))
    bare = notes.where(F.col("stub") & (F.size("l3") == 0))
    named = notes.select("id", F.explode("l3").alias("named")).withColumn("path", F.concat(F.lit("/"), F.ltrim("named", F.lit("/"))))
    found = named.join(tier, "path")
    lost = named.join(tier, "path", "left_anti")
    links = tier.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\[\[({NOTE_ID})\]\]"), F.lit(1)))).alias("id"))
    context = tier.where(F.contains("path", F.lit("/context/"))).select("path", F.explode(F.regexp_extract_all(F.element_at(F.split("path", "/"), -1), F.lit(f"({NOTE_ID})"), F.lit(1))).alias("id"))
    good = lambda rows: rows.join(ids, "id", "left_semi")
    bad = lambda rows: rows.join(ids, "id", "left_anti")
    reached = found.select("path").union(good(links).select("path")).union(good(context).select("path")).distinct()
    prose = files.where(F.col("path").isin("/AGENTS.md", "/Memory/INDEX.md")).agg(F.concat_ws("", F.collect_list("text")).alias("prose"))
    alone = tier.join(reached, "path", "left_anti").join(F.broadcast(prose)).where(~F.contains("prose", F.substring("path", 2, 1 << 20)) & ~F.contains("path", F.lit("/daily/")))  # one row, two files
    none = F.lit(None).cast("string")
    parts = [
        finding(bare, "C1", "FAIL", F.col("id"), none), finding(found, "C1", "PASS", F.col("id"), F.col("named")), finding(lost, "C1", "FAIL", F.col("id"), F.col("named")),
        finding(good(links), "C2", "PASS", F.col("path"), F.col("id")), finding(bad(links), "C2", "FAIL", F.col("path"), F.col("id")),
        finding(good(context), "C3", "PASS", F.col("path"), F.col("id")), finding(bad(context), "C3", "FAIL", F.col("path"), F.col("id")),
        finding(alone, "C4", "FAIL", F.col("path"), none),
        finding(found.where(~F.contains("text", F.col("id"))), "C5", "FAIL", F.col("id"), F.col("named")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def registry(findings: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(path, category, reached_by, counts, state) of the archival tier, from cross_tier's findings and evidence (path, support, challenge)."""
    tier = archival(files).select("path")
    by_note = findings.where("rule = 'C1' and level = 'PASS'").select(F.concat(F.lit("/"), F.ltrim("target", F.lit("/"))).alias("path"), F.col("subject").alias("by"))
    by_link = findings.where("rule in ('C2', 'C3') and level = 'PASS'").select(F.col("subject").alias("path"), F.col("target").alias("by"))
    reach = by_note.union(by_link).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("by")), ", ").alias("reached_by"))
    steps = F.split("path", "/")
    out = tier.join(reach, "path", "left").join(evidence, "path", "left")
    state = F.when(F.col("challenge") > 0, "contested").when(F.col("support") > 0, "supported").otherwise("-")
    counts = F.when(F.col("support").isNotNull(), F.concat_ws("/", F.col("support").cast("string"), F.col("challenge").cast("string"))).otherwise("-")
    return out.select("path", F.when(F.size(steps) > 3, F.get(steps, 2)).otherwise("-").alias("category"), F.coalesce("reached_by", F.lit("_(unreferenced)_")).alias("reached_by"), counts.alias("counts"), state.alias("state"))
