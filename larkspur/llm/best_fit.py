"""Packing documents into sequences by vector best-fit.

Pieces of equal length ask the same of a sequence: tokens, one document, and
attention cost (the square of their length).  So sequences are chosen for whole
classes: Spark counts the pieces of each length, best-fit places those counts, and
each piece finds its place by its rank among the pieces of its length.  The counts are
at most ``capacity`` numbers whatever the corpus, and the plan made of them has at most
one row for each length and state of a sequence; no list of documents or sequences is
ever in one place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import cluster, words
from larkspur.llm.token_store import SLICE_BYTES, BatchTokenizer


@dataclass(frozen=True)
class Limits:
    """What one sequence holds: tokens, documents, and the sum of its pieces' squared lengths."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def longest(self) -> int:
        """The length at which a document is cut: a piece of it must fit an empty sequence."""
        most = min(self.tokens, int(np.sqrt(float(self.attention))) + 1)
        while most * most > self.attention:
            most -= 1
        if min(most, self.documents) < 1:
            raise ValueError("a sequence must hold one token of one document")
        return most


WEIGHTS = (1.0, 1e-3, 1e-3)  # of tokens, documents and attention, each as a share of its limit


def best_fit(counts: dict[int, int], limits: Limits, measure: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """(placements, number of sequences) for so many pieces of each length, longest first.

    A placement row (length, first rank, pieces, copies, sequence, offset) says: the pieces of
    these ranks go to sequences from that one on, so many copies to each, from that offset.
    Of the states that sequences are in and that hold the piece under every limit, ``norm``
    takes the one whose weighted residual is shortest once the piece is in, ``dot`` the one
    whose residual has the largest weighted product with what the piece asks.  A new sequence
    is begun only where no state holds it.
    """
    most = (limits.tokens, limits.documents, limits.attention)
    weight = np.array(weights) / np.square(np.array(most, np.float64))
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals -> (first sequence, how many) of those in that state
    states, held = np.zeros((64, 3), np.float64), 0  # the keys of runs
    at_row: dict[tuple[int, int, int], int] = {}
    out, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        ask = (length, 1, length * length)
        while left:
            after = states[:held] - ask
            score = np.square(after) @ weight if measure == "norm" else -(states[:held] @ (weight * ask))
            score[(after < 0).any(axis=1)] = np.inf
            new = not held or np.isinf(score.min())
            key = most if new else tuple(map(int, states[score.argmin()]))
            # the shortest residual stays so until the sequence is full, and a new one is all that fits; a product falls with each piece
            copies = min(k // a for k, a in zip(key, ask)) if new or measure == "norm" else 1
            first, many = (used, left) if new else runs[key].pop()
            take, each = (min(many, left // copies), copies) if left >= copies else (1, left)
            out.append((length, rank, take * each, each, first, limits.tokens - key[0]))
            rank += take * each
            left -= take * each
            if new:
                used += take
            elif take < many:
                runs[key].append((first + take, many - take))
            elif not runs[key]:  # its row goes to the last state
                row, held = at_row.pop(key), held - 1
                del runs[key]
                if row < held:
                    states[row] = states[held]
                    at_row[tuple(map(int, states[row]))] = row
            key = tuple(k - a * each for k, a in zip(key, ask))
            if min(key) > 0:
                if key not in runs:
                    if held == len(states):
                        states = np.concatenate([states, np.zeros_like(states)])
                    states[held], at_row[key], runs[key] = key, held, []
                    held += 1
                runs[key].append((first, take))
    return np.array(out, np.int64).reshape(-1, 6), used


def least(counts: dict[int, int], limits: Limits) -> int:
    """No packing has fewer sequences: each limit allows so many."""
    asked = zip(*((n * k, n, n * k * k) for k, n in counts.items()))
    return max((-(-sum(a) // most) for a, most in zip(asked, (limits.tokens, limits.documents, limits.attention))), default=0)


def fewest(counts: dict[int, int], limits: Limits) -> np.ndarray:
    """The placements of the measure that needs fewer sequences; the second is tried only where the first may be beaten."""
    plan, used = best_fit(counts, limits, "norm")
    if used > least(counts, limits):
        other, fewer = best_fit(counts, limits, "dot")
        plan = other if fewer < used else plan
    return plan


def _pieces(shared, end_id: int, longest: int, with_ids: bool):
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of that length in the task's part."""

    def run(batches):
        tokenizer = words.of_worker(("tokenizer", shared.value), lambda: BatchTokenizer(shared.value))
        part = TaskContext.get().partitionId()
        met = np.zeros(longest + 1, np.int64)
        for batch in batches:
            for lo, hi, data, offs in words.text_parts(batch.column(1), SLICE_BYTES):
                ids, edge = tokenizer.encode(data, offs)
                full = np.insert(ids, edge[1:], end_id).astype("<u4")
                edge = edge + np.arange(len(edge))
                size = np.diff(edge)
                cuts = -(-size // longest)
                row = np.repeat(np.arange(hi - lo), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * longest
                length = np.minimum(size[row] - start, longest)
                begin = edge[row] + start
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first + met[ordered]
                met += np.bincount(length, minlength=longest + 1)
                raw = memoryview(full.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                columns = {
                    "doc_id": batch.column(0).slice(lo, hi - lo).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(row), part, np.int32)), "nth": pa.array(nth, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, edge[-1]), pa.int32()), pa.array(full.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)
        cluster.release()

    return run


def _placed(shared):
    """Gives each piece the sequence and offset that its length and rank have in the plan."""

    def run(batches):
        length, first, _, copies, sequence, offset = shared.value.T
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(size), np.int64)
            for one in np.unique(size).tolist():
                here = size == one
                lo, hi = np.searchsorted(length, [one, one + 1])
                at[here] = lo + np.searchsorted(first[lo:hi], rank[here], "right") - 1
            nth = rank - first[at]
            kept = batch.drop_columns(["rank"])
            placed = [pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * size)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *placed], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    Each text's ids and its end id are one piece; only a document longer than an empty
    sequence holds is cut, into pieces of that length and a rest.  Every sequence keeps
    within all limits, and its pieces lie side by side from offset 0.  Null and empty texts
    are their end id alone.  Every row is a document, also one that repeats or has no id.
    An empty table gives no pieces.  Other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    folder = cluster.shared_folder(spark)
    longest = limits.longest()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    pieces = cluster.written(rows.mapInArrow(_pieces(shared, end_id, longest, with_ids), schema), folder, "pieces")
    found = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = cluster.written(found.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), folder, "ranks")
    counts = ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length up to the limit
    plan = fewest({r.length: r.n for r in counts}, limits)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    ranked = pieces.join(ranks.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return ranked.select(*names, "rank").mapInArrow(_placed(plan), kept + ", sequence_id long, offset long")
