"""Hard negatives by a kNN join over a Voronoi partition.

The score is an inner product.  With M the longest vector's length, candidates become
(x, sqrt(M*M - |x|*|x|)) and anchors (q, 0): then |q' - x'|**2 = |q|**2 + M*M - 2 q.x, so
the highest scores are the nearest points, and what the triangle inequality says of
distances bounds scores.

Pivots, drawn from the anchors, deal both to cells.  First each cell's anchors meet its
own candidates; that gives each anchor a score that its last hit has at least.  Then a
candidate is copied only to those groups of anchors it might still serve: its
distance from a group's pivot, less and plus the group's radius, must reach into the
range of distances that the group's anchors still look for.  Each group scores exactly
what it gets, in whole numbers.  The exact search is done twice, for an anchor's
positives and then for the negatives in the score ranges that these set.

A cell with very many anchors is several groups, and a group's candidates are dealt by
hash to tiles of a bounded size, so neither a crowd of copies nor a frequent label is
one task's work.  The driver holds the pivots and a few numbers for each group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import cluster, words

PIVOTS = 8
MOST_PIVOTS = 1024
GROUP = 4096  # anchors that are scored together
TILE = 8192  # candidates that are scored together
TILES = 8  # parts of a group's candidates at least, so that small tables are shared out too
SLICE = 1024  # rows that are dealt together
LARGEST = float(1 << 62)
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
RANGES = pa.list_(pa.struct([(n, pa.int64()) for n in ("asked", "least", "most")]))


@dataclass(frozen=True)
class Task:
    """Which rows are anchors, how many positives and negatives, and a negative's least and largest score in hundredths of the positive's."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    least: int = 30
    largest: int = 90

    def __post_init__(self):
        if not 0 <= self.least <= self.largest <= 100:
            raise ValueError("a negative's score is between 0 and 100 hundredths of the positive's")

    def band(self, score):
        """Columns of the least and largest score that a negative may have; exact, none where least > largest."""
        wide = score.cast("decimal(20,0)")
        return F.ceil(wide * self.least / 100).cast("long"), F.floor(wide * self.largest / 100).cast("long")


@dataclass(frozen=True)
class Cells:
    """Of the vectors of one dimension: pivots, the longest vector's length, and the groups of anchors of each cell."""

    pivots: np.ndarray
    longest: float
    first: np.ndarray  # the first group of each cell; one more entry than cells
    slots: np.ndarray  # parts of each cell's own candidates
    away_slots: int
    radius: np.ndarray  # largest distance of a cell's anchors from its pivot

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (2 * x @ self.pivots.T - np.square(self.pivots).sum(axis=1)).argmax(axis=1)

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distance of each candidate, with its further coordinate, from each pivot."""
        square = self.longest**2 - 2 * x @ self.pivots.T + np.square(self.pivots).sum(axis=1)
        return np.sqrt(np.maximum(square, 0.0))


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond 64 bits they count as the largest or smallest of these."""
    limit = np.sqrt(2.0**53 / max(1, a.shape[1]))
    a_fits, c_fits = ((np.abs(m.astype(np.float64)) < limit).all(axis=1) for m in (a, c))
    out = (np.where(a_fits[:, None], a, 0).astype(np.float64) @ np.where(c_fits[:, None], c, 0).astype(np.float64).T).astype(np.int64)
    for rows, columns in ((np.flatnonzero(~a_fits), np.arange(len(c))), (np.flatnonzero(a_fits), np.flatnonzero(~c_fits))):
        if len(rows) and len(columns):
            exact = a[rows].astype(object) @ c[columns].astype(object).T
            out[np.ix_(rows, columns)] = np.minimum(np.maximum(exact, LEAST), MOST).astype(np.int64)
    return out


def whole_rows(vectors: DataFrame, scale: float, every: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v, d, anchor) of the rows that take part, v = floor(scale * entry) within 63 bits."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    whole = F.transform(v, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-LARGEST)), F.lit(LARGEST))))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    return rows.withColumn("d", F.size("v")).withColumn("anchor", F.pmod("vec_id", F.lit(every)) == 0)


CELLED = "vec_id long, label long, d int, anchor boolean, row long, x binary, cell int, length double, distance double"


def _celled(cells: dict[int, np.ndarray], width: str):
    """Gives each row its cell, and its length and distance from the cell's pivot; x is v in few bytes."""

    def run(batches):
        for batch in batches:
            for d in batch.column("d").unique().to_pylist():
                if d in cells:
                    part = batch.filter(pa.array(batch.column("d").to_numpy() == d))
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    x, p = v.astype(np.float64), cells[d]
                    cell = (2 * x @ p.T - np.square(p).sum(axis=1)).argmax(axis=1)
                    packed = words.strings(v.astype(width).ravel().view(np.uint8), np.arange(len(v) + 1) * d * np.dtype(width).itemsize, pa.binary())
                    more = [packed, pa.array(cell, pa.int32()), pa.array(np.linalg.norm(x, axis=1)), pa.array(np.linalg.norm(x - p[cell], axis=1))]
                    kept = part.select(["vec_id", "label", "d", "anchor", "row"])
                    yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, "x", "cell", "length", "distance"])

    return run


def _matrix(column, width: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), width).reshape(-1, d).astype(np.int64)


DEALT = "d int, group int, slot int, row long, vec_id long, label long, x binary, ranges array<struct<asked:long,least:long,most:long>>, anchor boolean"


def _dealt(cells: dict[int, Cells], width: str, reach: dict[int, tuple[np.ndarray, np.ndarray]] | None):
    """Copies of candidates for groups of anchors: without reach for those of their own cell, with it for those of others that they might serve."""

    def run(batches):
        for batch in batches:
            for d in batch.column("d").unique().to_pylist():
                here, c = batch.filter(pa.array(batch.column("d").to_numpy() == d)), cells[d]
                for lo in range(0, here.num_rows, SLICE):
                    part = here.slice(lo, SLICE)
                    cell, row = part.column("cell").to_numpy(), part.column("row").to_numpy()
                    of_group = np.repeat(np.arange(len(c.pivots)), np.diff(c.first))  # each group's cell
                    serves = cell[:, None] == of_group[None, :]
                    slots = c.slots[of_group]
                    if reach is not None:
                        least, most = reach[d]
                        away = c.away(_matrix(part.column("x"), width, d).astype(np.float64))[:, of_group]
                        slack = 1e-6 * (c.longest + c.radius[of_group])
                        serves = ~serves & (away <= most + c.radius[of_group] + slack) & (away >= least - c.radius[of_group] - slack)
                        slots = np.full(len(of_group), c.away_slots)
                    at, group = np.nonzero(serves)
                    slot = (words.mix(row[at].astype(np.uint64)) % slots[group].astype(np.uint64)).astype(np.int32)
                    taken = part.select(["row", "vec_id", "label", "x"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), d, np.int32)), pa.array(group.astype(np.int32)), pa.array(slot), *taken.columns, pa.nulls(len(at), RANGES), pa.array(np.zeros(len(at), bool))],
                        ["d", "group", "slot", "row", "vec_id", "label", "x", "ranges", "anchor"],
                    )

    return run


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


FOUND = "row long, asked long, found_id long, score long"


def _tile(task: Task, width: str, positive: bool):
    """Of one group's anchors and some candidates: the best of the same label, or of other labels in each range that is asked for."""

    def run(key, table):
        d = key[0].as_py()
        anchors, others = table.filter(table.column("anchor")), table.filter(pc.invert(table.column("anchor")))
        out = []
        if anchors.num_rows and others.num_rows:
            c, ids, rows, labels = _matrix(others.column("x"), width, d), *(others.column(n).to_numpy() for n in ("vec_id", "row", "label"))
            for lo in range(0, anchors.num_rows, 128):
                some = anchors.slice(lo, 128)
                scores = products(_matrix(some.column("x"), width, d), c)
                for s, row, label, ranges in zip(scores, some.column("row").to_pylist(), some.column("label").to_pylist(), some.column("ranges").to_pylist()):
                    if positive:
                        at = np.flatnonzero((labels == label) & (rows != row))
                        at = at[best(ids[at], s[at], task.positives)]
                        out += [(row, 0, i, v) for i, v in zip(ids[at].tolist(), s[at].tolist())]
                        continue
                    other = np.flatnonzero(labels != label)
                    for r in ranges:
                        at = other[(s[other] >= r["least"]) & (s[other] <= r["most"])]
                        at = at[best(ids[at], s[at], task.negatives)]
                        out += [(row, r["asked"], i, v) for i, v in zip(ids[at].tolist(), s[at].tolist())]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((),) * 4)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "asked").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Search:
    """The rows, dealt to cells, and what both searches over them share."""

    rows: DataFrame
    cells: dict[int, Cells]
    width: str
    task: Task
    folder: str

    def tiles(self, anchors: DataFrame, reach, positive: bool) -> DataFrame:
        """(row, asked, found_id, score) of all tiles; anchors are copied to each part of their group's candidates."""
        dealt = self.rows.mapInArrow(_dealt(self.cells, self.width, reach), DEALT)
        slots = F.col("slots") if reach is None else F.col("away_slots")
        asking = anchors.select("d", "group", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), "row", "vec_id", "label", "x", "ranges", F.lit(True).alias("anchor"))
        return dealt.union(asking).groupBy("d", "group", "slot").applyInArrow(_tile(self.task, self.width, positive), FOUND)

    def run(self, anchors: DataFrame, k: int, positive: bool, name: str) -> DataFrame:
        """The k best for each anchor and range: first in its own cell, then wherever the bounds leave something to find."""
        home = cluster.written(merged(self.tiles(anchors, None, positive), k), self.folder, f"{name}-home")
        floors = home.where(F.col("rank") == k).select("row", "asked", F.col("score").alias("floor"))
        # positives: any score will do until there are k; negatives: down to the range's end
        wanted = anchors.select("d", "group", "row", "square", F.explode("ranges").alias("r")).select("d", "group", "row", "square", "r.*").join(floors, ["row", "asked"], "left")
        far = F.when(F.coalesce("floor", "least").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.col("square") - 2 * F.coalesce("floor", "least").cast("double"), F.lit(0.0))))
        near = F.coalesce(F.sqrt(F.greatest(F.col("square") - 2 * F.col("most").cast("double"), F.lit(0.0))), F.lit(0.0))
        bounds = wanted.groupBy("d", "group").agg(F.max(far).alias("far"), F.min(near).alias("near")).collect()  # a row for each group of anchors
        reach = {d: (np.full(c.first[-1], np.inf), np.full(c.first[-1], -np.inf)) for d, c in self.cells.items()}
        for r in bounds:
            reach[r.d][0][r.group], reach[r.d][1][r.group] = r.near, r.far
        away = cluster.written(self.tiles(anchors, reach, positive), self.folder, f"{name}-away")
        return merged(home.drop("rank").union(away), k)


def dealt_to_cells(rows: DataFrame, task: Task, folder: str) -> Search | None:
    """Draws pivots, writes the rows with their cells, and lays out groups of anchors and parts of candidates; None without anchors."""
    highest = F.aggregate("v", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.abs(c)))
    sizes = rows.groupBy("d").agg(F.count_if("anchor").alias("anchors"), F.max(highest).alias("highest")).where("anchors > 0").collect()  # a row for each dimension
    if not sizes:
        return None
    highest = max(r.highest for r in sizes)
    width = next(w for w, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", MOST)) if highest < most)
    pivots = {}
    for r in sizes:
        some = rows.where(F.col("anchor") & (F.col("d") == r.d)).select("v").distinct()
        some = some.orderBy(F.xxhash64("v"), "v").limit(min(MOST_PIVOTS, max(PIVOTS, r.anchors // GROUP))).collect()
        pivots[r.d] = np.array([p.v for p in some], np.float64)
    named = rows.withColumn("row", F.monotonically_increasing_id())
    celled = cluster.written(named.mapInArrow(_celled(pivots, width), CELLED), folder, "cells")
    stats = celled.groupBy("d", "cell").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("length").alias("longest"), F.max(F.when(F.col("anchor"), F.col("distance"))).alias("radius")).collect()  # a row for each pivot
    cells = {}
    for d, p in pivots.items():
        mine = [r for r in stats if r.d == d]
        n, of, held, radius = sum(r.n for r in mine), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p))
        for r in mine:
            of[r.cell], held[r.cell], radius[r.cell] = r.n, r.anchors, r.radius or 0.0
        unit = min(TILE, -(-n // (TILES * len(p))))
        first = np.concatenate([[0], np.cumsum(-(-held // GROUP))])
        cells[d] = Cells(p, max(r.longest for r in mine), first, np.maximum(1, -(-of // unit)), max(TILES, -(-n // TILE)), radius)
    return Search(celled, cells, width, task, folder)


def mine_negatives(vectors: DataFrame, task: Task = Task(), scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row whose id is divisible by ``task.every``.

    Scores are inner products of floor(scale * entry).  An anchor's positives are the highest
    scores of its label, its negatives the highest of other labels within ``task.band`` of
    the positive's; ties go to the smaller id.  Results are exact.

    Rows with a null id or label, or a vector that is null, empty, or holds null or non-finite
    entries take no part; those that repeat, their id too, are rows like others.
    Vectors of different dimensions never meet.  Entries beyond 62 bits, and scores beyond 63,
    count as the largest or smallest of these.  An empty table, or one without anchors, gives
    no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    folder = cluster.shared_folder(spark)
    search = dealt_to_cells(whole_rows(vectors, scale, task.every, vec_id, embedding, label), task, folder)
    if search is None:
        return spark.createDataFrame([], out)
    layout = [(d, k, int(f), int(m), int(s), c.away_slots, c.longest) for d, c in search.cells.items() for k, (f, m, s) in enumerate(zip(c.first, np.diff(c.first), c.slots)) if m]
    layout = spark.createDataFrame(layout, "d int, cell int, first int, groups int, slots int, away_slots int, longest double")  # a row for each pivot
    anchors = search.rows.where("anchor").join(F.broadcast(layout), ["d", "cell"])
    anchors = anchors.withColumn("group", F.col("first") + F.pmod(F.xxhash64("row"), "groups").cast("int")).withColumn("square", F.col("length") ** 2 + F.col("longest") ** 2)
    span = lambda asked, least, most: F.struct(asked.cast("long").alias("asked"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    nothing = F.lit(None)
    whole = anchors.withColumn("ranges", F.array(span(F.lit(0), nothing, nothing)))
    positives = cluster.written(search.run(whole, task.positives, True, "positives").drop("asked", "rank"), folder, "positives")
    asked = positives.select("row", F.col("score").alias("asked")).distinct()
    ranges = asked.select("row", span(F.col("asked"), *task.band(F.col("asked"))).alias("r")).where("r.least <= r.most").groupBy("row").agg(F.collect_list("r").alias("ranges"))  # at most task.positives
    asking = cluster.written(anchors.join(ranges, "row"), folder, "asking")
    negatives = search.run(asking, task.negatives, False, "negatives")
    named = positives.join(search.rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row").select("row", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("asked"))
    pairs = named.join(negatives, ["row", "asked"])
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("asked").alias("positive_score"), F.col("score").alias("negative_score"))
