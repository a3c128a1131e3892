"""Lexical retrieval with graph expansion, recency and salience.

Documents have id, tokens, created and salience.  A query reads them once: its terms'
counts are checkpointed, some numbers a document, and all that follows works on these.
Corpus statistics are one row and stay in the plan; seeds are a table of some rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import recency
from larkspur.functions.text import tokens
from larkspur.operators.links import checkpointed

K1, B = 1.5, 0.75
WEIGHTS = {"lex": 0.45, "graph": 0.25, "recency": 0.10, "salience": 0.20}
HYBRID = {"lex": 0.30, "vec": 0.25, "graph": 0.25, "recency": 0.05, "salience": 0.15}


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, term, tf) from id and tokens."""
    return docs.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df)."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _is(term: str):
    return lambda t: t == F.lit(term)


def term_sizes(docs: DataFrame, query: list[str]) -> DataFrame:
    """(id, dl, t0, t1, ...): a document's length and how often it has each distinct query term, other columns but the tokens kept."""
    if not query:
        raise ValueError("the query has no tokens")
    counts = [F.size(F.filter("tokens", _is(q))).alias(f"t{i}") for i, q in enumerate(sorted(set(query)))]
    return docs.select(*[c for c in docs.columns if c not in ("tokens", "text")], F.greatest(F.size("tokens"), F.lit(1)).alias("dl"), *counts)


def scored(sized: DataFrame, query: list[str]) -> DataFrame:
    """Rows of term_sizes() with lex, their BM25; a repeated query term counts again, a document without one has 0."""
    terms = sorted(set(query))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        tf, df = F.col(f"t{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + query.count(q) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    kept = [c for c in sized.columns if c != "dl" and c not in {f"t{i}" for i in range(len(terms))}]
    return sized.join(F.broadcast(stats)).select(*kept, score.alias("lex"))  # stats is one row


def bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """(id, lex): BM25 of every document."""
    return scored(checkpointed(term_sizes(docs.select("id", "tokens"), query)), query)


def normalised(scores: DataFrame, column: str) -> DataFrame:
    """A column divided by its maximum, all 0 if that is not positive."""
    top = scores.agg(F.max(column).alias("_top"))
    return scores.join(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")  # one row


def build_edges(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """Symmetric (src, dst) edges from (id, mention) joined with (id, key); no loops."""
    hit = mentions.join(keys.select(F.col("id").alias("dst"), F.col("key").alias("mention")), "mention").where("id <> dst")
    return hit.select(F.col("id").alias("src"), "dst").union(hit.select("dst", "id")).distinct()


def seeds(scores: DataFrame, k: int = 5) -> DataFrame:
    """(seed, seed_lex): the k best documents with a positive score, ties to the smaller id."""
    return scores.where("lex > 0").orderBy(F.desc("lex"), "id").limit(k).select(F.col("id").alias("seed"), F.col("lex").alias("seed_lex"))


def graph_scores(first: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(id, graph): for each document the best seed_lex * decay ** hops over at most ``hops`` steps from the seeds."""
    reach = first.select("seed", "seed_lex", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    front = reach
    for hop in range(1, hops + 1):
        front = front.join(edges.withColumnRenamed("src", "id"), "id").select("seed", "seed_lex", F.col("dst").alias("id"), F.lit(hop).alias("hop")).distinct()
        reach = reach.union(front)
    first = reach.groupBy("seed", "seed_lex", "id").agg(F.min("hop").alias("hop")).where("hop > 0")
    return first.groupBy("id").agg(F.max(F.col("seed_lex") * F.pow(F.lit(decay), "hop")).alias("graph"))


def recency_scores(docs: DataFrame) -> DataFrame:
    """(id, recency) against the newest document; undated ones have 0.5."""
    dated = docs.select("id", "created")
    newest = dated.agg(F.max("created").alias("newest"))
    return dated.join(F.broadcast(newest)).select("id", recency(F.col("created"), F.col("newest")).alias("recency"))  # one row


def search(docs: DataFrame, edges: DataFrame, query: list[str], limit: int | None = 5, vectors: DataFrame | None = None, floor: float = 0.35, salience: DataFrame | None = None) -> DataFrame:
    """The best documents by the weighted sum of their scores, with the route that found each; all of them without a limit.

    vectors has (id, cosine); those below floor count as none, and if none is left
    the weights without vectors hold.  salience (id, salience) may come apart from the
    documents, so that it is joined to their counts and not to their texts.
    """
    sized = term_sizes(docs.select("id", "tokens", "created", *(["salience"] if salience is None else [])), query)
    if salience is not None:
        sized = sized.join(salience, "id", "left").withColumn("salience", F.coalesce("salience", F.lit(0.5)))
    rows = checkpointed(normalised(scored(checkpointed(sized), query), "lex"))
    first = checkpointed(seeds(rows))
    out = rows.join(graph_scores(first, edges), "id", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
    newest = rows.agg(F.max("created").alias("newest"))
    out = out.join(F.broadcast(newest)).withColumn("recency", recency(F.col("created"), F.col("newest")))  # one row
    weights, near = WEIGHTS, F.lit(False)
    if vectors is not None:
        close = checkpointed(vectors.where(F.col("cosine") >= floor))
        if close.head(1):
            vec = normalised(close.select("id", F.greatest("cosine", F.lit(0.0)).alias("vec"), "cosine"), "vec")
            out = out.join(vec, "id", "left").withColumn("vec", F.coalesce("vec", F.lit(0.0)))
            weights, near = HYBRID, F.coalesce(F.col("cosine") >= floor, F.lit(False))
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    route = F.when(F.col("lex") > 0, "lexical").when(F.col("graph") > 0, "graph").when(near, "vector").otherwise("-")
    out = out.withColumn("score", score).withColumn("route", route).where((F.col("lex") > 0) | (F.col("graph") > 0) | near)
    return out if limit is None else out.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def vectors_active(n: int, switch: bool | None = None, least: int = 1000) -> bool:
    """Whether vectors take part: as the switch says, else from ``least`` documents on."""
    return n >= least if switch is None else switch


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("tokens", tokens(F.col(text)))


def project(files: DataFrame) -> DataFrame:
    """Documents of (path, text): title, created, salience, own ids, mentions of others, tokens with those of the title twice more."""
    from larkspur.functions.text import title_of

    ids = r"MEM-\d{4}-\d{4}"
    named = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    out = files.withColumn("title", title_of(F.col("text"), named))
    day = F.regexp_extract("text", r"(?m)^created:\s*(\d{4}-\d{2}-\d{2})", 1)
    weight = F.regexp_extract("text", r"(?im)^\**salience:?\**:?\s*([01](?:\.\d+)?)", 1)
    own = F.array_distinct(F.concat(F.regexp_extract_all("path", F.lit(f"({ids})"), F.lit(1)), F.regexp_extract_all("title", F.lit(f"({ids})"), F.lit(1))))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({ids}|Memory/[\\w./-]+\\.md)"), F.lit(1)))
    out = out.withColumn("created", F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")).withColumn("salience", F.coalesce(F.nullif(weight, F.lit("")).try_cast("double"), F.lit(0.5)))
    out = out.withColumn("self_ids", own).withColumn("mentions", F.array_except(found, own))
    body, head = tokens(F.col("text")), tokens(F.col("title"))
    return out.withColumn("tokens", F.concat(body, head, head))
