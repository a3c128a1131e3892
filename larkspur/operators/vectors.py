"""Vector search and the maintenance of a vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import dot, hamming, sign_bits


def against(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Every vector with the one query vector (query has one row, column q)."""
    return vectors.join(F.broadcast(query.limit(1)))


def above_floor(vectors: DataFrame, query: DataFrame, floor: float = 0.35) -> DataFrame:
    """(id, cosine) of all unit vectors that reach the floor."""
    return against(vectors, query).select("id", dot(F.col("v"), F.col("q")).alias("cosine")).where(F.col("cosine") >= floor)


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """(id, cosine) of the k nearest unit vectors."""
    return above_floor(vectors, query, floor).orderBy(F.desc(F.round("cosine", 9)), "id").limit(k)


def hamming_topk(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, distance) of the k nearest sign codes."""
    scored = against(vectors, query).select("id", hamming(sign_bits(F.col("v")), sign_bits(F.col("q"))).cast("long").alias("distance"))
    return scored.orderBy("distance", "id").limit(k)


def gated(vectors: DataFrame, query: DataFrame, n: int, floor: float = 0.35, prefilter: int = 50, above: int = 10_000) -> DataFrame:
    """(id, cosine) at or above the floor: of all vectors, or beyond ``above`` of them of the ``prefilter`` nearest by sign code."""
    return above_floor(vectors, query, floor) if n <= above else two_pass(vectors, query, prefilter, prefilter, floor)


def two_pass(vectors: DataFrame, query: DataFrame, k: int, prefilter: int = 50, floor: float = 0.35) -> DataFrame:
    """Nearest by sign code first, then by cosine among those."""
    near = against(vectors, query).withColumn("distance", hamming(sign_bits(F.col("v")), sign_bits(F.col("q"))))
    near = near.orderBy("distance", "id").limit(prefilter).select("id", dot(F.col("v"), F.col("q")).alias("cosine"))
    return near.where(F.col("cosine") >= floor).orderBy(F.desc(F.round("cosine", 9)), "id").limit(k)


def index_delta(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(id, status) from (id, content_hash) tables: built, reused or pruned."""
    new, old = texts.select("id", F.col("content_hash").alias("now")), index.select("id", F.col("content_hash").alias("was"))
    status = F.when(F.col("now").isNull(), "pruned").when(F.col("now").eqNullSafe(F.col("was")), "reused").otherwise("built")
    return new.join(old, "id", "full_outer").select("id", status.alias("status"))


def fingerprint(model: str, parts: list[bytes]) -> str:
    """Hash that tells whether an index was made by the same model."""
    import hashlib

    return hashlib.sha256(model.encode() + b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()


def merged_index(texts: DataFrame, fresh: DataFrame, index: DataFrame) -> DataFrame:
    """(key, content_hash, embedding): embeddings of unchanged texts from the index, of others from fresh (key, embedding); those of lost texts go."""
    old = index.select("key", F.col("content_hash").alias("was"), F.col("embedding").alias("kept"))
    out = texts.select("key", "content_hash").join(old, "key", "left").join(fresh, "key", "left")
    return out.select("key", "content_hash", F.when(F.col("was").eqNullSafe(F.col("content_hash")), F.col("kept")).otherwise(F.col("embedding")).alias("embedding"))


def write_index(index: DataFrame, path: str, model: str, model_hash: str) -> None:
    """An index (key, content_hash, embedding) with a row on how it was made."""
    index.write.mode("overwrite").parquet(f"{path}/vectors")
    made = index.sparkSession.read.schema(index.schema).parquet(f"{path}/vectors")
    facts = made.agg(F.lit(model).alias("model"), F.lit(model_hash).alias("model_hash"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.count("*").alias("count"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def valid_index(facts: DataFrame, vectors: DataFrame, model: str, model_hash: str) -> DataFrame:
    """The vectors (key, content_hash, embedding) if the row of facts names this model and its hash, and their number and sizes are as it says; none otherwise."""
    seen = vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") >= 0).alias("sized"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    good = (F.col("model") == model) & (F.col("model_hash") == model_hash) & (F.col("n") == F.col("count")) & ((F.col("n") == 0) | ((F.col("least") == F.col("dim")) & (F.col("most") == F.col("dim"))))
    return vectors.join(F.broadcast(facts.join(F.broadcast(seen)).where(good).select(F.lit(True).alias("good")))).drop("good")  # one row


def read_index(spark, path: str, model: str, model_hash: str) -> DataFrame | None:
    """A written index if it is there, whole and of this model; None otherwise."""
    from pyspark.errors import AnalysisException

    try:
        facts, vectors = spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None
    out = valid_index(facts, vectors, model, model_hash)
    return out if out.head(1) or not vectors.head(1) else None
