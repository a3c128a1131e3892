"""Nearest neighbours and exact top-k by blocks of vectors.

Candidates are dealt by hash to blocks of about BLOCK vectors, queries likewise;
each pair of a query block and a candidate block is a tile, one task's work, of
bounded size whatever the data.  An exact search meets each query with each candidate,
so the number of tiles grows with queries times candidates.  A tile returns at most k
rows a query.

Every row is a candidate, those that repeat an id too, and every row whose id is
divisible by ``every`` is a query of all rows but itself.  Null ids, null, empty, or not
all finite vectors take no part; vectors of different dimensions never meet.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
TILES = 32  # candidate blocks at least, so that small tables are shared out too


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, d) of the rows that take part."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~bad)
    return rows.withColumn("d", F.size("v"))


def blocks(rows: DataFrame, every: int) -> tuple[int, int]:
    """How many blocks of candidates and of queries there are."""
    n, asked = rows.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    return max(TILES, -(-n // BLOCK)), max(1, -(-asked // BLOCK))


def tiles(rows: DataFrame, every: int, n_c: int, n_q: int, floor: DataFrame | None = None) -> DataFrame:
    """Rows (cblock, qblock, d, query, row, vec_id, v, floor): each candidate once per query block, each query once per candidate block.

    row names a row, the same one as candidate and as query: both come from one pass.
    """
    rows = rows.withColumn("row", F.xxhash64("vec_id", "v", F.monotonically_increasing_id()))
    rows = rows.withColumn("floor", F.lit(None).cast("long")) if floor is None else rows.join(floor, "vec_id", "left")
    cblock, qblock = (F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int") for salt, n in ((1, n_c), (2, n_q)))
    tile = lambda c, q, query: F.struct(c.alias("cblock"), q.alias("qblock"), F.lit(query).alias("query"))
    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(n_q - 1)), lambda q: tile(cblock, q, False))
    as_query = F.transform(F.sequence(F.lit(0), F.lit(n_c - 1)), lambda c: tile(c, qblock, True))
    both = F.when(F.pmod("vec_id", F.lit(every)) == 0, F.concat(as_candidate, as_query)).otherwise(as_candidate)
    return rows.select(F.explode(both).alias("t"), "d", "row", "vec_id", "v", "floor").select("t.cblock", "t.qblock", "d", "t.query", "row", "vec_id", "v", "floor")


def _split(table):
    """(ids, matrix, rows) of candidates and of queries, ascending, and the queries' floors."""
    table = table.sort_by([("query", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
    v = table.column("v").combine_chunks()
    d = table.column("d")[0].as_py()
    matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    query = table.column("query").to_numpy().astype(bool)
    floor = table.column("floor").filter(pa.array(query)).to_pylist()
    return ids[~query], matrix[~query], rows[~query], ids[query], matrix[query], rows[query], floor


def _found(rows, kind):
    q, r, c, s = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "row": pa.array(r, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, kind)})


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, their largest component between 0.5 and 1: nothing overflows or vanishes in their norms."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    half = exponent // 2  # in two steps, as 2 ** 1074 is no double
    return np.ldexp(np.ldexp(v, -half[:, None]), (half - exponent)[:, None])


def quantised(unit: np.ndarray):
    """(int8 matrix, scale, length of the error) of each row."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
    small = np.rint(unit / scale).astype(np.int8)
    return small, scale[:, 0], np.linalg.norm(unit - small * scale, axis=1)


def _cosine_tile(k: int):
    def run(key, table):
        ids, c, c_rows, asked, q, q_rows, _ = _split(table)
        rows = []
        if len(ids) and len(asked):
            c, q = scaled(c), scaled(q)
            c_norm, q_norm = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
            qc, sc, ec = quantised(c / c_norm[:, None])
            qq, sq, eq = quantised(q / q_norm[:, None])
            wide = np.float64 if c.shape[1] > 1000 else np.float32
            whole = qc.astype(wide)  # products of int8 sum to less than 2**24 up to 1040 dimensions, so float32 holds them
            for lo in range(0, len(asked), 256):
                hi = min(lo + 256, len(asked))
                near = (qq[lo:hi].astype(wide) @ whole.T).astype(np.float64) * sq[lo:hi, None] * sc[None, :]
                err = eq[lo:hi, None] + (1 + eq[lo:hi, None]) * ec[None, :] + 1e-12
                near[q_rows[lo:hi, None] == c_rows[None, :]] = -np.inf
                kth = np.partition(near - err, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                who, at = np.nonzero((near + err >= kth[:, None]) & np.isfinite(near))
                exact = np.einsum("ij,ij->i", q[lo + who], c[at]) / (q_norm[lo + who] * c_norm[at])
                edge = np.searchsorted(who, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    part = range(edge[i], edge[i + 1])
                    for j in heapq.nsmallest(k, part, key=lambda j: (-exact[j], ids[at[j]])):
                        rows.append((int(asked[lo + i]), int(q_rows[lo + i]), int(ids[at[j]]), float(exact[j])))
        return _found(rows, pa.float64())

    return run


FOUND = "query_id long, row long, vec_id long, score "


def nearest_by_blocks(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines for each row whose id is divisible by ``every``.

    int8 product tiles bound every cosine: |uv - u'v'| <= |u-u'| + (1 + |u-u'|) |v-v'|.
    Pairs whose upper bound reaches the query's k-th lower bound are recomputed in
    double precision and go through a heap; the tiles' heaps merge by query.  The
    result is exact, also for very large and very small components.  Zero vectors take
    no part either.
    """
    rows = usable(vectors, vec_id, embedding).where(F.exists("v", lambda x: x != 0))
    found = tiles(rows, every, *blocks(rows, every)).groupBy("cblock", "qblock", "d").applyInArrow(_cosine_tile(k), FOUND + "double")
    return best_of(found, k)


class BallTree:
    """Centres and radii of nested halves of a set of vectors."""

    def __init__(self, points: np.ndarray, leaf: int = 96):
        self.points, self.centre, self.radius, self.kids, self.members = points, [], [], [], []
        self._grow(np.arange(len(points)), leaf)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, at: np.ndarray, leaf: int) -> int:
        me = len(self.kids)
        some = self.points[at]
        centre = some.mean(axis=0)
        away = np.linalg.norm(some - centre, axis=1)
        self.centre.append(centre)
        self.radius.append(away.max())
        self.kids.append(())
        self.members.append(at)
        if len(at) > leaf and away.max() > 0:
            a = some[away.argmax()]
            b = some[np.linalg.norm(some - a, axis=1).argmax()]
            order = np.argsort(some @ (b - a), kind="stable")
            half = len(at) // 2
            self.kids[me] = (self._grow(at[order[:half]], leaf), self._grow(at[order[half:]], leaf))
        return me

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with each node's points, rounding included."""
        length, reach = np.linalg.norm(queries, axis=1)[:, None], self.radius[None, :]
        slack = 1e-9 * length * (np.linalg.norm(self.centre, axis=1)[None, :] + reach)
        return queries @ self.centre.T + length * reach + slack


MOST, LEAST = (1 << 63) - 1, -(1 << 63)
KEPT = 200_000  # found rows that a tile holds before it cuts them to k a query


def exact_products(points: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of vectors of whole numbers, exact also where doubles would round; kept within 64 bits."""
    if points.shape[1] * np.abs(points).max(initial=0.0) * np.abs(query).max(initial=0.0) < 1 << 53:
        return (points @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query.tolist()]
    return [min(max(sum(int(x) * y for x, y in zip(p, whole)), LEAST), MOST) for p in points.tolist()]


def _products(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products of each query with each point, as int64; one matrix product where doubles hold all sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        narrow = points.shape[1] * np.abs(points).max(initial=0.0) * np.abs(queries).max(axis=1, initial=0.0) < 1 << 53
    out = np.empty((len(queries), len(points)), np.int64)
    out[narrow] = queries[narrow] @ points.T
    for i in np.flatnonzero(~narrow):
        out[i] = exact_products(points, queries[i])
    return out


class _Best:
    """The k best (score, id) of each query seen so far, and the score that others must reach."""

    def __init__(self, floor: list, k: int):
        self.k, self.held, self.size = k, [], 0
        self.floor = np.array([LEAST if f is None else f for f in floor], np.int64)
        self.known = np.array([f is not None for f in floor], bool)

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> bool:
        """Takes rows; whether floors may have risen."""
        self.held.append((who, ids, score))
        self.size += len(who)
        if self.size <= KEPT + 2 * self.k * len(self.floor):
            return False
        self.cut()
        return True

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, ~score, who))  # ~ turns the order around, for the smallest number too
        who, ids, score = who[order], ids[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        last = rank == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], score[last])
        self.known[who[last]] = True
        self.held = [(who[rank < self.k], ids[rank < self.k], score[rank < self.k])]
        self.size = len(self.held[0][0])
        return self.held[0]


def _product_tile(k: int, scale: float, probe: bool):
    """Of one tile: each query's k best; with probe only those of its first leaf, as a first bound.

    Queries go down the tree together: a node is left to those whose bound for it reaches
    their floor, and a leaf meets all that come to it in one product.
    """

    def run(key, table):
        ids, c, c_rows, asked, q, q_rows, floor = _split(table)
        if not len(ids) or not len(asked):
            return _found([], pa.int64())
        with np.errstate(over="ignore"):
            largest = np.finfo(np.float64).max
            c, q = (np.clip(np.floor(scale * x), -largest, largest) for x in (c, q))
        # bounds are taken at a scale at which nothing overflows
        _, unit = np.frexp(max(np.abs(c).max(), np.abs(q).max()))
        unit = max(0, int(unit) - 400)
        tree = BallTree(np.ldexp(c, -unit))
        upper = tree.upper(np.ldexp(q, -unit))
        best = _Best(floor, k)
        edges = lambda: np.array([_shrunk(f, 2 * unit) if known else -np.inf for f, known in zip(best.floor.tolist(), best.known.tolist())])
        edge = edges()

        def meet(node: int, active: np.ndarray) -> bool:
            rose, at = False, tree.members[node]
            if len(at) > k + 1 and tree.radius[node] == 0 and (c[at] == c[at[0]]).all():
                at = at[: k + 1]  # equal points in order of id: none behind these can be among k of another row
            for lo in range(0, len(active), 1024):
                who = active[lo : lo + 1024]
                score = _products(c[at], q[who])
                i, j = np.nonzero((score >= best.floor[who, None]) & (c_rows[at][None, :] != q_rows[who, None]))
                rose |= best.add(who[i], ids[at[j]], score[i, j])
            return rose

        if probe:
            leaves = np.flatnonzero([not x for x in tree.kids])
            first = leaves[upper[:, leaves].argmax(axis=1)]
            for node in np.unique(first):
                meet(node, np.flatnonzero(first == node))
        else:
            queue = [(0, np.arange(len(asked)))]
            while queue:
                node, active = queue.pop()
                active = active[upper[active, node] >= edge[active]]
                if not len(active):
                    continue
                if tree.kids[node]:
                    queue += sorted(((kid, active) for kid in tree.kids[node]), key=lambda x: upper[active, x[0]].mean())  # the nearer one first
                elif meet(node, active):
                    edge = edges()
        who, near, score = best.cut() if best.held else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(asked[who], pa.int64()), "row": pa.array(q_rows[who], pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _shrunk(score: int, bits: int) -> float:
    """score / 2**bits, at most its true value."""
    return float(np.nextafter(np.ldexp(float(score), -bits), -np.inf)) if bits else float(np.nextafter(float(score), -np.inf)) if abs(score) >= 1 << 53 else float(score)


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) for each row whose id is divisible by ``every``.

    Each shard has a ball tree, which its queries go down together: a node's points have at
    most q . centre + |q| * radius.  A first round takes each shard's best leaf; the
    k-th best of all shards is then the score every shard starts from in the second,
    so a shard without near points stops at its root.  Scores are exact integers; those
    beyond 64 bits count as the largest or smallest of these.
    """
    rows = usable(vectors, vec_id, embedding)
    n = blocks(rows, every)
    first = tiles(rows, every, *n).groupBy("cblock", "qblock", "d").applyInArrow(_product_tile(k, scale, True), FOUND + "long")
    kth = best_of(first, k).where(F.col("rank") == k).groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"))  # of rows that repeat an id, the lowest
    found = tiles(rows, every, *n, kth).groupBy("cblock", "qblock", "d").applyInArrow(_product_tile(k, scale, False), FOUND + "long")
    return best_of(found, k)
