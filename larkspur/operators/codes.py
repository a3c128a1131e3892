"""Exact nearest sign codes without a scan: multi-index hashing.

A code is cut into chunks of 16 bits, and an index row stands for each chunk of each distinct
code.  Two codes that differ in fewer bits than (flips + 1) times the number of chunks
agree in one chunk but for that many flips, so looking up each chunk of a query with up to
that many bits flipped finds all of them.  A query is done once its k-th distance is below that
bound; those that are not after the last round are compared with all codes, by tiles of
blocks.  A round whose lookups would cost more than that is left out.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import dot, sign_bits
from larkspur.operators.links import checkpointed, written

CHUNK = 16
BLOCK = 1 << 16  # codes in a block of the scan
ASKED = 1 << 12  # queries in one
HIT = 400  # distances of the scan that cost as much as one code found by a lookup, about


def code_of(v: Column, dim: int) -> Column:
    """Sign bits of ``dim`` components, 64 in each long."""
    return F.array(*[sign_bits(F.slice(v, a + 1, 64)) for a in range(0, dim, 64)])


def code_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def chunks_of(code: Column, dim: int) -> Column:
    """(chunk, value) of each 16 bits of a code."""
    cut = lambda c: F.call_function("shiftrightunsigned", F.get(code, F.lit(c // 4)), F.lit(CHUNK * (c % 4))).bitwiseAND(F.lit((1 << CHUNK) - 1))
    return F.array(*[F.struct(F.lit(c).alias("chunk"), cut(c).cast("int").alias("value")) for c in range(-(-dim // CHUNK))])


def code_index(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """((id, code) of (id, v), (chunk, value, code) of the distinct codes); null vectors have no code."""
    codes = written(vectors.where(F.size("v") == dim).select("id", code_of(F.col("v"), dim).alias("code")))  # read in each round
    buckets = codes.select("code").distinct().select("code", F.explode(chunks_of(F.col("code"), dim)).alias("c")).select("c.chunk", "c.value", "code")
    return codes, buckets


def write_codes(codes: DataFrame, buckets: DataFrame, path: str) -> None:
    """The index beside the vectors: buckets in order, so a lookup reads few row groups."""
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    buckets.repartitionByRange("chunk", "value").sortWithinPartitions("chunk", "value").write.mode("overwrite").parquet(f"{path}/buckets")


def read_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/buckets")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The codes at the k smallest distances of each query, ties included."""
    order = Window.partitionBy("query").orderBy("distance")
    return found.withColumn("place", F.rank().over(order)).where(F.col("place") <= k).drop("place")


def _gathered(most: int, by: str):
    """A task's rows (by, code) as blocks of at most ``most``, in ascending order of ``by`` in each."""

    def block(parts):
        table = pa.concat_tables(parts).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[(by, "ascending")]))
        flat = table.column("code").combine_chunks().flatten().to_numpy()
        return pa.RecordBatch.from_arrays([pa.array([table.column(by).to_pylist()], pa.list_(table.schema.field(by).type)), pa.array([flat.astype(np.int64).tobytes()], pa.binary())], ["ids", "codes"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ASKED):
                parts.append(pa.Table.from_batches([batch.slice(lo, min(ASKED, most - rows))]))
                rows += parts[-1].num_rows
                left = batch.slice(lo + parts[-1].num_rows, ASKED - parts[-1].num_rows)
                if rows == most:
                    yield block(parts)
                    parts, rows = [], 0
                if left.num_rows:
                    parts.append(pa.Table.from_batches([left]))
                    rows += left.num_rows
        if parts:
            yield block(parts)

    return run


def _scan_tiles(k: int):
    """Of each query in a block and codes in a block the k nearest codes, ties to the smaller first id."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids = batch.column("q_ids")[i].values, batch.column("c_ids")[i].values
                q, c = (np.frombuffer(batch.column(f"{p}_codes")[i].as_buffer(), np.uint64).reshape(len(x), -1) for p, x in (("q", asked), ("c", ids)))
                columns = np.ascontiguousarray(c.T)
                kth = min(k, len(ids)) - 1
                for lo in range(0, len(q), 64):
                    part = q[lo : lo + 64]
                    apart = sum((np.bitwise_count(part[:, w, None] ^ column[None, :]).astype(np.uint16 if len(columns) > 3 else np.uint8) for w, column in enumerate(columns)))
                    least = np.partition(apart, kth, axis=1)[:, kth]
                    who, at = np.nonzero(apart <= least[:, None])
                    d = apart[who, at]
                    # ascending in id already, so a stable order by distance has the smaller id first
                    order = np.lexsort((at, d, who))
                    who, at, d = who[order], at[order], d[order]
                    first = np.searchsorted(who, np.arange(len(part)))
                    keep = np.arange(len(who)) - first[who] <= kth
                    who, at, d = who[keep], at[keep], d[keep]
                    code = pa.FixedSizeListArray.from_arrays(pa.array(c[at].view(np.int64).ravel()), c.shape[1]).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(lo + who)), ids.take(pa.array(at)), code, pa.array(d.astype(np.int64))], ["query", "first", "code", "distance"])

    return run


def scanned(codes: DataFrame, waiting: DataFrame, k: int) -> DataFrame:
    """(query, code, distance): of each of waiting (query, code) the k nearest codes of (id, code), ties to the smaller first id.

    Every query meets every distinct code in a tile of two blocks, which gives out k rows a
    query; more codes for one id could not be among its k nearest ids.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*codes.schema, waiting.schema["query"]]}
    firsts = written(codes.groupBy("code").agg(F.min("id").alias("first")).select("first", "code"))
    blocks = lambda rows, most, by: rows.repartition(max(1, -(-rows.count() // most)), "code").mapInArrow(_gathered(most, by), f"ids array<{kinds['id' if by == 'first' else by]}>, codes binary")
    held = lambda p, made: made.select(*[F.col(x).alias(f"{p}_{x}") for x in made.columns])
    tiles = held("c", written(blocks(firsts, BLOCK, "first"))).join(held("q", written(blocks(waiting.select("query", "code"), ASKED, "query"))))
    found = tiles.mapInArrow(_scan_tiles(k), f"query {kinds['query']}, first {kinds['id']}, code array<bigint>, distance bigint")
    order = Window.partitionBy("query").orderBy("distance", "first")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "code", "distance")


def nearest_codes(codes: DataFrame, buckets: DataFrame, queries: DataFrame, k: int, dim: int, flips: int = 3) -> DataFrame:
    """(query, id, distance): of each query (query, code) the k ids whose codes are nearest, ties to the smaller id.

    Exact, by lookups with up to ``flips`` bits flipped in each chunk; queries that these leave
    open, or with fewer than k codes within reach, meet all distinct codes, block by block.  A
    round is left to that scan where its lookups would find so many codes, by the mean size of a
    bucket, that the scan is cheaper.  Of ids with one code only the k smallest can count, so
    copies cost nothing.
    """
    n_chunks = -(-dim // CHUNK)
    n_codes = buckets.where("chunk = 0").count()
    waiting, found, done = queries.select("query", "code"), None, []
    for s in range(flips + 1):
        if HIT * n_chunks * comb(CHUNK, s) * (1 + n_codes / (1 << CHUNK)) > max(n_codes, BLOCK):
            done.append(scanned(codes, waiting, k))
            break
        masks = [sum(1 << b for b in bits) for bits in combinations(range(CHUNK), s)]
        probes = waiting.select("query", F.col("code").alias("asked"), F.explode(chunks_of(F.col("code"), dim)).alias("c"))
        probes = probes.select("query", "asked", "c.chunk", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("c.value").bitwiseXOR(m))).alias("value"))
        hits = probes.join(buckets, ["chunk", "value"]).select("query", "asked", "code").distinct()
        hits = hits.select("query", "code", code_distance(F.col("asked"), F.col("code")).alias("distance"))
        found = hits if found is None else found.join(waiting.select("query"), "query", "left_semi").unionByName(hits).distinct()
        found = checkpointed(_best(found, k))
        reach = n_chunks * (s + 1) - 1
        # codes within reach are all found, so k of them settle a query
        settled = checkpointed(found.where(F.col("distance") <= reach).groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query"))
        done.append(found.join(settled, "query", "left_semi"))
        waiting = checkpointed(waiting.join(settled, "query", "left_anti"))
        if not waiting.take(1):
            break
    else:
        done.append(scanned(codes, waiting, k))
    near = done[0]
    for part in done[1:]:
        near = near.unionByName(part)
    first = codes.withColumn("turn", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("turn") <= k).drop("turn")
    order = Window.partitionBy("query").orderBy("distance", "id")
    return near.join(first, "code").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "distance")


def indexed_search(vectors: DataFrame, queries: DataFrame, k: int, dim: int, prefilter: int = 50, floor: float = -1.0, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, id, cosine): of each query (query, v) the k best cosines at or above the floor among its ``prefilter`` nearest codes; vectors (id, v) of length one."""
    codes, buckets = index or code_index(vectors, dim)
    near = nearest_codes(codes, buckets, queries.select("query", code_of(F.col("v"), dim).alias("code")), prefilter, dim)
    scored = near.join(vectors.select("id", "v"), "id").join(queries.select("query", F.col("v").alias("q")), "query").select("query", "id", dot(F.col("v"), F.col("q")).alias("cosine")).where(F.col("cosine") >= floor)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "cosine")
