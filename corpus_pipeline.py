"""Documents to training tokens: five stages, each one operator of larkspur.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import cluster
from larkspur.llm.ngram_join import join_similar
from larkspur.llm.queries import tokenizer_file
from larkspur.llm.source_mix import WORD, mix_sources
from larkspur.llm.substring_dedup import dedup_substrings
from larkspur.llm.toxicity import fit_toxicity, keep_clean
from larkspur.llm.unigram_pieces import encode_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel SVM predicts as toxic go; all others stay as they are.

    Null and empty texts are scored like others, repeated rows and null ids are rows like
    others, a score of exactly 0.5 is toxic, an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs.select(COLUMNS), fit_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by Jaccard >= 0.8 of 5-word shingles, one with the smallest id stays.

    A null id is the smallest; of rows with equal ids that with the smallest hash of id
    and text stays, of equal ones that with the least other columns.  Rows without a word
    are linked with nothing and all stay.  An empty table gives an empty one.
    """
    folder = cluster.shared_folder(spark)
    found = cluster.written(join_similar(docs, n=5, percent=80).where("n_shingles > 0").select("root", "doc_id", "uid"), folder, "found")
    least = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "uid")
    groups = found.groupBy("root").agg(F.min(least).alias("first")).select("root", "first.doc_id", "first.uid")
    same = found.groupBy("root", "uid").agg(F.count("*").alias("copies"))
    firsts = cluster.written(groups.join(same, ["root", "uid"]).select("uid", F.col("doc_id").alias("first_id"), "copies"), folder, "firsts")
    rows = cluster.with_uid(docs.select(COLUMNS))
    kept = rows.join(firsts, (rows["uid"] == firsts["uid"]) & rows["doc_id"].eqNullSafe(firsts["first_id"])).select(*COLUMNS, rows["uid"], "copies")
    wordless = rows.where(F.coalesce(~F.col("text").rlike(WORD), F.lit(True))).select(COLUMNS)
    if not firsts.where("copies > 1").head(1):
        return kept.select(COLUMNS).unionByName(wordless)
    # rows that agree in id and text need a choice
    rest = F.struct("lang", "source", "n_chars", "text", "doc_id")
    several = kept.where("copies > 1").groupBy("uid").agg(F.min(rest).alias("r")).select("r.doc_id", "r.text", "r.lang", "r.source", "r.n_chars")
    return kept.where("copies = 1").select(COLUMNS).unionByName(several).unionByName(wordless)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows that a document with a smaller id has too are cut out; other texts stay unchanged.

    A null id counts as the smallest, so rows without an id lose nothing; rows with one id
    do not cut each other.  Null, empty and short texts stay as they are; every row stays.
    """
    rest = F.struct("lang", "source", "n_chars")
    out = dedup_substrings(docs.withColumn("rest", rest), 50, rest="rest", verbatim=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, with the words taken; whole texts stay unchanged.

    Rows are told apart by the hash of all their columns.  Those that agree in all have
    one text, so each of their shares of the mix can be cut from any of them.  Null ids
    and sources are values like others; null, empty and wordless texts have no words to
    take and go.  An empty table gives an empty one.
    """
    keyed = docs.select(COLUMNS).withColumn("row_key", F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    folder = cluster.shared_folder(spark)
    taken = mix_sources(keyed, row_key="row_key").where("taken > 0").select("row_key", F.col("size").alias("mix_size"), F.col("pieces").alias("mix_pieces"))
    taken = cluster.written(taken, folder, "taken")
    twice = cluster.written(keyed.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), folder, "twice")
    rows = keyed
    if twice.head(1):
        rows = keyed.join(twice, "row_key", "left_anti").unionByName(keyed.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"]))
    rows = rows.join(taken, "row_key")
    turns = F.explode(F.sequence(F.lit(1), F.array_max(F.transform("mix_pieces", lambda p: p.times)).cast("int")))
    rows = rows.withColumn("turn", turns).withColumn("now", F.filter("mix_pieces", lambda p: p.times >= F.col("turn")))
    n = F.aggregate("now", F.lit(0).cast("long"), lambda a, p: a + p.words)
    some = F.expr(rf"array_join(flatten(transform(now, p -> slice(regexp_extract_all(text, r'({WORD})', 1), cast(p.first + 1 as int), cast(p.words as int)))), ' ')")
    text = F.when(n == F.col("mix_size"), F.col("text")).otherwise(some)
    rows = rows.withColumn("whole", n == F.col("mix_size")).withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Unigram pieces of every row's text, checked by decoding; null and empty texts have none, every row stays."""
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("pieces", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = cluster.shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = cluster.written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
