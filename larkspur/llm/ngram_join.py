"""N-gram Jaccard join by prefixes under several global token orders.

A document's set are its distinct shingles of n lower-cased words.  Two sets of
sizes a and b can only reach the threshold t if, under any global order of tokens,
the first a - ceil(t * a) + SHARED tokens of one and likewise of the other have SHARED
in common (or all that the threshold asks for, if fewer).  So candidates must share
that many prefix tokens under each of ORDERS orders, and the orders' candidates are
intersected before sets are compared.

Equal sets are one node (64-bit fingerprint of the set).  Tokens are 61-bit polynomial
hashes of shingles under secret keys of the run (words.Keys), so no text can be made to
collide.  Tokens that several prefixes hold come last in every order, each order has its own hash; any such table of
frequent tokens gives a valid order, so its size is bounded without losing links.

1. One pass finds each document's size and fingerprint and counts prefix tokens.
2. A second pass deals prefix tokens by hash to buckets, which keep the tokens that
   two or more nodes share.
3. Pairs that share enough tokens of at most CROWD nodes each are compared.  Tokens
   of more nodes, as large groups of near copies have, compare each node with one,
   the token's pivot.  The links found make components.
4. Nodes joined by crowded tokens form crowds.  Within a crowd of several components
   all sets are compared in tiles, as products of incidence matrices; a tile returns
   which components it links, not pairs.  A crowd of one component, as most near
   copies of a text are by then, needs no comparison.  Tiles hold at most about TILE
   sets and TILE_TOKENS tokens a side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster, words
from larkspur.llm.components import components

ORDERS = 2
SHARED = 4
FREQUENT = 3  # prefixes that hold a token that counts as frequent
TABLE = 2_000_000  # frequent tokens at most, the most frequent ones
CROWD = 48
SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A68DE, 0xC2B2AE3D27D4EB4F)
TILE, TILE_TOKENS = 1024, 2_000_000
BUCKET_BYTES = 4 << 20  # of text, for each bucket of prefix tokens
SLICE = 1 << 19  # bytes of text a task turns into sets at once
COUNT, DOC = 0, 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, keys: words.Keys):
    """(tokens, offsets, fingerprints): each text's distinct shingles, ascending."""
    data = words.LOWER[data]
    starts, ends, first = words.word_spans(data, offs)
    h = words.word_hashes(data, starts, ends, keys)
    _, row, token = words.windows(h, first, n, keys)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    whole = words.span_hash(words.prefix_sums(h, keys.base), first[short], first[short + 1], keys)
    row, token = np.concatenate([row, short]), np.concatenate([token, whole])
    order = np.argsort(token)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    row, token = row[order], token[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[keep], token[keep]
    edge = np.searchsorted(row, np.arange(len(offs)))
    mark = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(token ^ np.uint64(SEEDS[2])), dtype=np.uint64)])
    sums = mark[edge[1:]] - mark[edge[:-1]]
    print_ = words.mix(sums + np.diff(edge).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return token, edge, print_


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(size, size - (-(-size * percent // 100)) + SHARED)


def prefixes(token: np.ndarray, edge: np.ndarray, percent: int, seed: int, frequent: np.ndarray) -> np.ndarray:
    """Positions in token of each set's prefix, under the order (frequent, hash by seed)."""
    key = words.mix(token ^ np.uint64(seed)) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
        key |= (frequent[at] == token).astype(np.uint64) << np.uint64(63)
    size = np.diff(edge)
    row = np.repeat(np.arange(len(size), dtype=np.uint32), size)
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    rank = np.arange(len(token)) - np.repeat(edge[:-1], size)
    return order[rank < np.repeat(prefix_length(size, percent), size)]


def _measure(n: int, percent: int, keys: words.Keys, n_buckets: int):
    """Rows of sizes and fingerprints, and packed counts of prefix tokens."""

    def counts(held):
        token, count = np.unique(np.concatenate(held), return_counts=True)
        rows = [(b, cluster.pack(token[at], count[at].astype(np.uint32))) for b, at in cluster.by_part((token % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
        return batch_of(COUNT, bucket=[b for b, _ in rows], blob=[x for _, x in rows])

    def batch_of(kind, bucket=None, blob=None, doc_id=None, uid=None, size=None, node=None):
        m = len(bucket if bucket is not None else size)
        null = lambda t: pa.nulls(m, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), null(pa.int32()) if bucket is None else pa.array(bucket, pa.int32()), null(pa.binary()) if blob is None else pa.array(blob, pa.binary()), null(pa.int64()) if doc_id is None else doc_id, null(pa.int64()) if uid is None else uid, null(pa.int64()) if size is None else pa.array(size, pa.int64()), null(pa.int64()) if node is None else pa.array(node, pa.int64())], ["kind", "bucket", "blob", "doc_id", "uid", "n", "node"])

    def run(batches):
        words.forget()
        held, total = [], 0
        for batch in batches:
            for lo, hi, data, offs in words.text_parts(batch.column(2), SLICE):
                token, edge, node = shingle_sets(data, offs, n, keys)
                yield batch_of(DOC, doc_id=batch.column(0).slice(lo, hi - lo), uid=batch.column(1).slice(lo, hi - lo), size=np.diff(edge), node=node)
                some = np.unique(np.concatenate([prefixes(token, edge, percent, SEEDS[o], np.zeros(0, np.uint64)) for o in range(ORDERS)]))
                held.append(token[some])
                total += len(held[-1])
                if total > 500_000:
                    yield counts(held)
                    held, total = [], 0
        if total:
            yield counts(held)
        cluster.release()

    return run


def _frequent(key, table):
    token, count = (np.concatenate(x) for x in zip(*(cluster.unpack(b) for b in table.column("blob").to_pylist())))
    token, at = np.unique(token, return_inverse=True)
    total = np.bincount(at, weights=count).astype(np.int64)
    keep = total >= FREQUENT
    return pa.table({"token": pa.array(token[keep].view(np.int64), pa.int64()), "n": pa.array(total[keep], pa.int64())})


def _postings(shared, n: int, percent: int, keys: words.Keys, n_buckets: int):
    def run(batches):
        frequent = shared.value
        held = []

        def flush():
            node, size, order_, token = (np.concatenate(x) for x in zip(*held))
            part = ((token >> np.uint64(32)) % np.uint64(n_buckets // ORDERS)).astype(np.int64) * ORDERS + order_
            rows = []
            for b, at in cluster.by_part(part, n_buckets):
                ids, first = np.unique(node[at], return_index=True)
                rank = np.searchsorted(ids, node[at])
                rows.append((b, cluster.pack(ids, size[at][first].astype(np.uint32), rank.astype(np.uint32), (token[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))))
            a, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.binary())], ["bucket", "blob"])

        total, met = 0, np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offs in words.text_parts(batch.column(0), SLICE):
                token, edge, node = shingle_sets(data, offs, n, keys)
                size = np.diff(edge)
                row = np.repeat(np.arange(len(size)), size)
                _, once = np.unique(node, return_index=True)
                fresh = np.zeros(len(size), bool)
                fresh[once] = True
                fresh &= ~np.isin(node, met)
                met = np.concatenate([met, node[fresh]])
                for o in range(ORDERS):
                    at = prefixes(token, edge, percent, SEEDS[o], frequent)
                    at = at[fresh[row[at]]]
                    held.append((node[row[at]], size[row[at]], np.full(len(at), o), token[at]))
                    total += len(at)
                if total > 400_000:
                    yield flush()
                    held, total, met = [], 0, np.zeros(0, np.int64)
        if total:
            yield flush()
        cluster.release()

    return run


def _shared_tokens(key, table):
    """Of a bucket: (order, token, node, n, m, pivot, pivot_n) for the tokens of m > 1 nodes; the pivot is the smallest node."""
    parts = [cluster.unpack(b) for b in table.column("blob").to_pylist()]
    node = np.concatenate([ids[rank] for ids, _, rank, _ in parts])
    size = np.concatenate([s[rank] for _, s, rank, _ in parts]).astype(np.int64)
    token = np.concatenate([t for *_, t in parts])
    order = np.lexsort((node, token))
    node, size, token = node[order], size[order], token[order]
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
    node, size, token = node[keep], size[keep], token[keep]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(token)))
    pivot, pivot_n = np.repeat(node[first], count), np.repeat(size[first], count)
    at = np.repeat(count, count) > 1
    b = int(key[0].as_py())
    return pa.table({"order": pa.array(np.full(at.sum(), b % ORDERS, np.int32)), "token": pa.array((np.int64(b) << 32) + token[at].astype(np.int64)), "node": pa.array(node[at]), "n": pa.array(size[at]), "m": pa.array(np.repeat(count, count)[at]), "pivot": pa.array(pivot[at]), "pivot_n": pa.array(pivot_n[at])})


def _sets(n: int, keys: words.Keys):
    def run(batches):
        for batch in batches:
            for _, _, data, offs in words.text_parts(batch.column(0), SLICE):
                token, edge, node = shingle_sets(data, offs, n, keys)
                six = np.ascontiguousarray(token >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(node), words.strings(six, edge * 6, pa.binary())], ["node", "tokens"])

    return run


def _tokens(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _compare(percent: int):
    """Of one node and its partners: the links."""

    def run(key, table):
        node, blob = table.column("node").to_pylist(), table.column("tokens")
        me = key[0].as_py()
        if me not in node:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        mine = _tokens(blob[node.index(me)].as_py())
        out = []
        for other, b in zip(node, blob):
            if other != me:
                theirs = _tokens(b.as_py())
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = int((mine[at] == theirs).sum())
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    out.append(other)
        return pa.table({"u": pa.array(out, pa.int64()), "v": pa.array([me] * len(out), pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; v's partners come to it in lots of at most about TILE."""
    lots = pairs.groupBy("v").agg(F.ceil(F.count("*") / TILE).cast("int").alias("lots"))
    theirs = pairs.join(lots, "v").select("v", F.pmod(F.xxhash64("u"), "lots").alias("lot"), F.col("u").alias("node")).join(sets, "node")
    mine = lots.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots").cast("long") - 1)).alias("lot"), F.col("v").alias("node")).join(sets, "node")
    every = theirs.select("v", "lot", "node", "tokens").union(mine.select("v", "lot", "node", "tokens"))
    return every.groupBy("v", "lot").applyInArrow(_compare(percent), "u long, v long")


def _incidence(blobs: list[bytes], wanted: np.ndarray):
    """(row, column) of the wanted tokens in each set."""
    sets = [_tokens(b) for b in blobs]
    row = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    token = np.concatenate(sets)
    at = np.minimum(np.searchsorted(wanted, token), len(wanted) - 1)
    hit = wanted[at] == token
    return row[hit], at[hit]


def _cross_links(percent: int):
    """Of one tile of a crowd: links between nodes of different components, one for each two components."""

    def run(key, table):
        side = table.column("side").to_numpy()
        node, size, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
        blobs = table.column("tokens").to_pylist()
        a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # side 0 is both, on the diagonal
        u, v = [], []
        if len(a) and len(b) and (comp[a].min() != comp[b].max() or comp[a].max() != comp[b].min()):
            tokens = [np.unique(np.concatenate([_tokens(blobs[k]) for k in x])) for x in (a, b)]
            both = np.intersect1d(*tokens, assume_unique=True)
            if len(both):
                (ra, ca), (rb, cb) = _incidence([blobs[k] for k in a], both), _incidence([blobs[k] for k in b], both)
                common = np.zeros((len(a), len(b)), np.int64)
                step = 512
                for lo in range(0, len(both), step):
                    left, right = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
                    x, y = (ca >= lo) & (ca < lo + step), (cb >= lo) & (cb < lo + step)
                    left[ra[x], ca[x] - lo] = 1
                    right[rb[y], cb[y] - lo] = 1
                    common += (left @ right.T).astype(np.int64)  # sums of up to ``step`` ones are exact
                for lo in range(0, len(a), 256):
                    i = a[lo : lo + 256]
                    near = 100 * common[lo : lo + 256] >= percent * (size[i][:, None] + size[b][None, :] - common[lo : lo + 256])
                    x, y = np.nonzero(near & (comp[i][:, None] != comp[b][None, :]))
                    u.append(comp[i[x]])
                    v.append(comp[b[y]])
        pairs = np.unique(np.column_stack([np.concatenate(u), np.concatenate(v)]), axis=0) if u else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(pairs.max(axis=1)), "v": pa.array(pairs.min(axis=1))})

    return run


def _small_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that share enough tokens of few nodes under every order."""
    few = found.where(F.col("m") <= CROWD).select("order", "token", "node", "n")
    a, b = few.select("order", "token", F.col("node").alias("v"), F.col("n").alias("nv")), few.select("token", F.col("node").alias("u"), F.col("n").alias("nu"))
    pairs = a.join(b, "token").where((F.col("v") < F.col("u")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")))
    counts = [F.count_if(F.col("order") == o).alias(f"c{o}") for o in range(ORDERS)]
    least = F.least(F.lit(SHARED), F.ceil(F.lit(percent) * F.greatest("nu", "nv") / 100))
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(*counts)
    for o in range(ORDERS):
        pairs = pairs.where(F.col(f"c{o}") >= least)
    return pairs.select("u", "v")


def _crowded_links(crowd: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of components within each crowd of (node, n, crowd)."""
    named = crowd.join(labels.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("crowd").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.sum("n").alias("tokens")).where("a <> b")
    sides = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("tokens") / TILE_TOKENS)).cast("int")
    rows = named.join(mixed.select("crowd", sides.alias("g")), "crowd").withColumn("x", F.pmod(F.xxhash64("comp", F.when(F.col("g") > 1, F.col("node"))), "g").cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda y: F.struct(F.least("x", y).alias("i"), F.greatest("x", y).alias("j"), F.when(F.col("x") == y, 0).when(F.col("x") < y, 1).otherwise(2).alias("side"))))
    rows = rows.join(sets, "node").select("crowd", "node", "n", "comp", "tokens", tile.alias("t")).select("crowd", "node", "n", "comp", "tokens", "t.i", "t.j", "t.side")
    return rows.groupBy("crowd", "i", "j").applyInArrow(_cross_links(percent), "u long, v long").distinct()


def join_similar(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links of Jaccard >= percent / 100), uid, root.

    uid is a hash of id and text, root names the component (null without shingles); rows
    of different components may share a component_id where ids repeat.  Null, empty and
    wordless texts have no shingles and no links.  A null id sorts before all others.
    Repeated rows are equal sets.  An empty table gives an empty result.  Other columns
    are not read.  Sets are compared by 48-bit tokens.
    """
    spark = docs.sparkSession
    folder = cluster.shared_folder(spark)
    keys = words.Keys.new()
    docs = cluster.with_uid(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    n_buckets = ORDERS * 2 * cluster.parts(spark, cluster.text_bytes(docs), BUCKET_BYTES)
    seen = cluster.written(docs.select("doc_id", "uid", "text").mapInArrow(_measure(n, percent, keys, n_buckets), "kind int, bucket int, blob binary, doc_id long, uid long, n long, node long"), folder, "measured")
    common = seen.where(F.col("kind") == COUNT).select("bucket", "blob").groupBy("bucket").applyInArrow(_frequent, "token long, n long")
    common = common.orderBy(F.desc("n"), "token").limit(TABLE).select("token").toArrow().column("token").to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    measured = seen.where(F.col("kind") == DOC).select("doc_id", "uid", "n", "node")
    nodes = measured.where("n > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(int(cluster.NULL_ID)))).alias("least"), F.min("uid").alias("uid"))

    postings = docs.select("text").mapInArrow(_postings(shared, n, percent, keys, n_buckets), "bucket int, blob binary")
    found = cluster.written(postings.groupBy("bucket").applyInArrow(_shared_tokens, "order int, token long, node long, n long, m long, pivot long, pivot_n long"), folder, "shared")
    crowded = found.where(F.col("m") > CROWD)
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    stars = crowded.where((F.col("node") != F.col("pivot")) & fits).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    pairs = cluster.written(_small_pairs(found, percent).union(stars).distinct(), folder, "pairs")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(crowded.select("node")).distinct().join(nodes, "node").select("node", "uid")
    sets = docs.join(wanted, "uid").select("text").mapInArrow(_sets(n, keys), "node long, tokens binary").dropDuplicates(["node"])
    sets = cluster.written(sets, folder, "sets")

    links = cluster.written(_links(pairs, sets, percent), folder, "links1")
    labels = components(links, f"{folder}/c1")
    gathered = components(crowded.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("u"), F.col("pivot").alias("v")), f"{folder}/c0")
    crowd = crowded.select("node", "n").distinct().join(gathered.select(F.col("u").alias("node"), F.col("v").alias("crowd")), "node", "left").withColumn("crowd", F.coalesce("crowd", "node"))
    more = cluster.written(_crowded_links(crowd, labels, sets, percent), folder, "links2")
    if more.head(1):
        labels = components(labels.union(more), f"{folder}/c2")
    for name in ("shared", "pairs", "sets", "links1", "links2", "c0"):
        cluster.drop_folder(spark, f"{folder}/{name}")

    rooted = nodes.join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(least, "root").select("node", "root", F.nullif("component", F.lit(int(cluster.NULL_ID))).alias("component_id"))
    out = measured.join(known, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "uid", F.when(F.col("n") > 0, F.col("root")).alias("root"))
