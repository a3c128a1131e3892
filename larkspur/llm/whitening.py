"""Whitening of vectors by a tall-skinny QR factorisation.

Vectors are taken as whole numbers x = floor(scale * c) + shift.  One pass sums them
exactly; a second centres each partition's rows by those sums and keeps the R factor
of their QR factorisation; R factors merge in a tree, some at a time, until one is left.
The right singular vectors of that R are the components, its singular values their
scales: no covariance of x is formed.  A third pass measures the whitened rows.

What the driver holds is of the size of a vector's dimension, or its square: sums, R,
components.  Vectors of different dimensions are whitened apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster

BATCH = 4096  # rows that are factored together
FAN = 16  # R factors that merge at once
LARGEST = float(1 << 62)


@dataclass(frozen=True)
class Whole:
    """Entries as whole numbers, floor(scale * c) + shift, within 63 bits."""

    scale: float = 64.0
    shift: int = 1_000_000

    def of(self, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(self.scale * c), -LARGEST, LARGEST).astype(np.int64) + self.shift


@dataclass(frozen=True)
class Centre:
    """n vectors of one dimension and their exact sums, as the whole mean and what n times it lacks."""

    n: int
    mean: np.ndarray  # int64
    rest: np.ndarray  # object: sums - n * mean, each between 0 and n

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is subtracted first, so nothing cancels."""
        return _from(x, self.mean) - (self.rest / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sums)**2, exact; kept within 64 bits."""
        y = _from(x, self.mean)
        largest, n = float(np.abs(y).max(initial=0.0)), self.n
        if len(self.mean) * largest * max(largest, float(n)) < 1 << 62:
            y = y.astype(np.int64)
            square, cross = (y * y).sum(axis=1), y @ self.rest.astype(np.int64)
        else:
            y = x.astype(object) - self.mean
            square, cross = (y * y).sum(axis=1), y @ self.rest
        own = int((self.rest * self.rest).sum())
        if n >= 1 << 31 or n * n * float(np.abs(square).max(initial=0)) + 2 * n * float(np.abs(cross).max(initial=0)) + own >= 1 << 62:
            square, cross = square.astype(object), cross.astype(object)
            return np.minimum(n * n * square - 2 * n * cross + own, (1 << 63) - 1).astype(np.int64)
        return n * n * square - 2 * n * cross + own


def _from(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x - mean in double precision, without overflow."""
    near = np.abs(x) < 1 << 61
    return np.where(near, x - np.where(near, mean, 0), x.astype(np.float64) - mean) if not near.all() and len(x) else (x - mean).astype(np.float64)


@dataclass(frozen=True)
class Whitener:
    """What whitens the vectors of one dimension: components are columns, with their eigenvalues and shares of the trace."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def from_r(centre: Centre, r: np.ndarray, most: int) -> Whitener:
    """Right singular vectors of R, by falling singular value; directions in which no vector differs are none."""
    _, s, vt = np.linalg.svd(r)
    s = np.append(s, np.zeros(len(vt) - len(s)))
    kept = s[:most] > s.max(initial=0.0) * len(vt) * np.finfo(np.float64).eps * 8
    v = vt[:most][kept].T
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else v
    total = float(s @ s)
    return Whitener(centre, v, s[:most][kept] ** 2 / centre.n, s[:most][kept] ** 2 / total if total else s[:0])


def _matrices(batches, whole: Whole):
    """(ids, whole numbers) of the rows of each batch that take part, by dimension and at most BATCH at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            ids, v = part.column(0), part.column(1)
            size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = v.flatten().cast(pa.float64())
            bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            edge = np.concatenate([[0], np.cumsum(size)])
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = (size > 0) & (wrong[edge[1:]] == wrong[edge[:-1]])
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            for d in np.unique(size[good]).tolist():
                at = np.flatnonzero(good & (size == d))
                yield ids.take(pa.array(at)), whole.of(values[edge[at][:, None] + np.arange(d)])


def _sums(whole: Whole):
    """Rows (d, position, n, high, low) of a partition: its sums are high * 2**32 + low."""

    def run(batches):
        found: dict[int, list] = {}
        for _, x in _matrices(batches, whole):
            high = x >> 32
            new = [len(x), high.sum(axis=0), (x - (high << 32)).sum(axis=0)]
            have = found.get(x.shape[1])
            found[x.shape[1]] = new if have is None else [a + b for a, b in zip(have, new)]
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(d, d, np.int32)), "position": pa.array(np.arange(d, dtype=np.int32)), "n": pa.array(np.full(d, n, np.int64)), "high": pa.array(high), "low": pa.array(low)})

    return run


def _folded(found: dict[int, np.ndarray], d: int, rows: np.ndarray) -> None:
    """Takes rows, or another R, into the R factor of one dimension."""
    found[d] = np.linalg.qr(np.concatenate([found[d], rows]) if d in found else rows, mode="r")


def _factors(whole: Whole, centres: dict[int, Centre]):
    """Rows (d, node, r) of a partition: the R factor of its centred rows."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for _, x in _matrices(batches, whole):
            _folded(found, x.shape[1], centres[x.shape[1]].centred(x))
        yield _r_rows(found, TaskContext.get().partitionId())

    return run


def _r_rows(found: dict[int, np.ndarray], node: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([node] * len(found), pa.int64()), pa.array([r.tobytes() for r in found.values()], pa.binary())], ["d", "node", "r"])


def _merged(key, table):
    """One R factor from those of a group, in the order of their nodes."""
    d, node = (k.as_py() for k in key)
    found: dict[int, np.ndarray] = {}
    for r in table.sort_by("node").column("r").to_pylist():
        _folded(found, d, np.frombuffer(r, np.float64).reshape(-1, d))
    return pa.Table.from_batches([_r_rows(found, node)])


def _moments(whole: Whole, models: dict[int, Whitener]):
    """Rows (d, i, j, value) of a partition: products of whitened components summed, and with j = -1 their sums."""

    def run(batches):
        found: dict[int, list] = {}
        for _, x in _matrices(batches, whole):
            w = models[x.shape[1]].whitened(x)
            new = [w.T @ w, w.sum(axis=0)]
            have = found.get(x.shape[1])
            found[x.shape[1]] = new if have is None else [a + b for a, b in zip(have, new)]
        for d, (products, sums) in found.items():
            i, j = np.triu_indices(len(sums))
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(i) + len(sums), d, np.int32)), "i": pa.array(np.append(i, np.arange(len(sums))), pa.int32()), "j": pa.array(np.append(j, np.full(len(sums), -1)), pa.int32()), "value": pa.array(np.append(products[i, j], sums))})

    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(whole: Whole, models: dict[int, Whitener], errors: dict[int, float]):
    def run(batches):
        for ids, x in _matrices(batches, whole):
            model = models[x.shape[1]]
            w, k = model.whitened(x), len(model.eigenvalues)
            if k:
                at = np.repeat(np.arange(len(x)), k)
                columns = [ids.take(pa.array(at)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(at), model.centre.n), model.centre.deviation(x)[at], w.ravel(), np.tile(model.explained, len(x)), np.full(len(at), errors[x.shape[1]])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in OUT.split(", ")])

    return run


def exact_sums(vectors: DataFrame, whole: Whole) -> dict[int, Centre]:
    """Of each dimension, how many vectors there are and their sums."""
    parts = vectors.mapInArrow(_sums(whole), "d int, position int, n long, high long, low long")
    whole_sum = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = parts.groupBy("d", "position").agg(F.sum("n").alias("n"), whole_sum("high").alias("high"), whole_sum("low").alias("low")).orderBy("d", "position").collect()  # a row for each dimension
    by: dict[int, list] = {}
    for r in sums:
        by.setdefault(r.d, []).append((r.n, int(r.high) * (1 << 32) + int(r.low)))
    return {d: Centre.of(got[0][0], [s for _, s in got]) for d, got in by.items()}


def tsqr(vectors: DataFrame, whole: Whole, centres: dict[int, Centre]) -> dict[int, np.ndarray]:
    """The R factor of all centred vectors of each dimension; every level of the tree is written to the shared folder."""
    folder, level = cluster.shared_folder(vectors.sparkSession), 0
    nodes = cluster.written(vectors.mapInArrow(_factors(whole, centres), "d int, node long, r binary"), folder, "level0")
    while (nodes.agg(F.max("node")).first()[0] or 0) > 0:
        level += 1
        up = nodes.groupBy("d", F.floor(F.col("node") / FAN).alias("up")).applyInArrow(_merged, "d int, node long, r binary")
        nodes = cluster.written(up, folder, f"level{level}")
    return {r.d: np.frombuffer(r.r, np.float64).reshape(-1, r.d) for r in nodes.collect()}  # one for each dimension


def identity_errors(vectors: DataFrame, whole: Whole, models: dict[int, Whitener]) -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    parts = vectors.mapInArrow(_moments(whole, models), "d int, i int, j int, value double")
    got = parts.groupBy("d", "i", "j").agg(F.sum("value").alias("value")).collect()  # a row for each two components
    mean = {(r.d, r.i): r.value / models[r.d].centre.n for r in got if r.j < 0}
    errors = {d: 0.0 for d in models}
    for r in got:
        if r.j >= 0:
            off = r.value / models[r.d].centre.n - mean[r.d, r.i] * mean[r.d, r.j] - (r.i == r.j)
            errors[r.d] = max(errors[r.d], abs(off))
    return errors


def fit_whitener(vectors: DataFrame, whole: Whole = Whole(), components: int = 32, embedding: str = "embedding") -> dict[int, Whitener]:
    """A whitener for each dimension that occurs."""
    rows = vectors.select(F.lit(0).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    centres = exact_sums(rows, whole)
    return {d: from_r(centres[d], r, components) for d, r in tsqr(rows, whole, centres).items()}


def whiten(vectors: DataFrame, whole: Whole = Whole(), components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries take no part; those
    that repeat, or have no id, count like others.  Components come by falling eigenvalue,
    the largest entry of each positive; where vectors differ in fewer directions than
    ``components`` there are only so many, and of one vector, or equal ones, none.  Entries
    beyond 62 bits count as the largest or smallest of these, deviations beyond 63 bits as the
    largest.  An empty table gives no rows.  Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    models = fit_whitener(vectors, whole, components, embedding)
    errors = identity_errors(rows, whole, models)
    return rows.mapInArrow(_rows(whole, models, errors), OUT)
