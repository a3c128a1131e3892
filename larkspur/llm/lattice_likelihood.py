"""LM scoring by subword lattice likelihood.

A text's probability is the sum over all its segmentations into units, by forward
recursion in log space.  Its lattice has four kinds of arcs:

* pieces of an existing unigram vocabulary, weighed by the vocabulary's scores (a score
  of -r is rank r, and rank r weighs 1 / (r + 2.7)) and adapted to the corpus: a piece's
  probability is (e + prior * weight) / (sum of e + prior), e being how often the piece
  is expected over all segmentations of each distinct training word, for ROUNDS rounds;
* words of the training part, with absolute discounting by D, so that with the pieces'
  paths, whose sum is P_lattice, P(word) = max(c - D, 0) / N + D * V / N * P_lattice(word)
  (c, N, V: count, all tokens and distinct tokens; for the end of a text c / N);
* words again that the text had before: token i, whose word came j times before, has
  (a * P(word) + j) / (a + i), a being ``concentration``;
* phrases that the training part has twice or more.  A phrase is the run of words between
  two anchors, words whose hash under fixed keys is divisible by ANCHOR (so that reruns
  agree); at such a place a phrase arc is
  taken with theta * c / C, or words with 1 - theta (C: phrases on arcs, counted each time;
  theta: C over all runs between anchors and one more).

As phrases never overlap, the recursion adds up one run after the other.  ``score`` is
log10 of the text's sum; ``lattice_score`` that of the pieces alone; ``base_score`` an
add-0.1 unigram model's.

1. A task turns a chunk of some MB of texts into its distinct words and phrases' hashes,
   dealt by hash to buckets with their training counts, and its texts as numbers of
   these, which stay where they are until step 4.
2. Buckets make a lexicon of their distinct training words; each round adds up the
   pieces expected in it, one sum a task.
3. A bucket adds the counts, computes each distinct word's lattice once and answers
   every chunk for its words and phrases.
4. Chunks put answers and texts together.

A word crosses the network once per chunk, not once per occurrence, so a word or
a source with a third of all rows weighs no more than others.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster, words
from larkspur.llm.lattice import MARK, Vocabulary, expected_pieces, in_steps, log_marginal

CHUNK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20  # of text, for each bucket of words and phrases
WORDS, PHRASES, TEXTS, ANSWER, COUNTS, TOTALS = range(6)
DISCOUNT = 0.75
PRIOR, ROUNDS = (1000.0, 100.0, 100.0), 3  # pieces that the first scores count for, in each round
ANCHOR = 8
ANCHOR_KEYS = words.Keys.new(1)
HELD_OUT = 10


def held_out(ids: np.ndarray, parts: int = HELD_OUT) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i == cluster.NULL_ID else str(i).encode()) % parts == 0 for i in ids.tolist()), bool, len(ids))


def runs_of(hashes: np.ndarray, per_doc: np.ndarray):
    """(start, stop) of the runs of words up to an anchor or a text's end."""
    close = (hashes >> np.uint64(40)) % np.uint64(ANCHOR) == 0
    close[np.cumsum(per_doc)[per_doc > 0] - 1] = True
    stop = np.flatnonzero(close) + 1
    return np.concatenate([[0], stop[:-1]]) if len(stop) else stop, stop


def _dealt(keys: np.ndarray, n_buckets: int):
    """(order, place of each key in it, (bucket, from, to) of the buckets that occur)."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    return order, place, [(int(b), int(edge[b]), int(edge[b + 1])) for b in np.flatnonzero(np.diff(edge))]


def _chunks(keys: words.Keys, n_buckets: int, chunk_bytes: int = CHUNK_BYTES):
    def flush(held, chunk):
        ids, data, starts, ends, per_doc = (np.concatenate(x) for x in zip(*held))
        shift = np.repeat(np.cumsum([0] + [len(h[1]) for h in held[:-1]]), [len(h[2]) for h in held])
        starts, ends = starts + shift, ends + shift
        held.clear()
        out = held_out(ids)
        learnt = ~np.repeat(out, per_doc)
        code, sample = words.distinct_words(data, starts, ends)
        h = words.word_hashes(data, starts[sample], ends[sample], keys)
        trained = np.bincount(code[learnt], minlength=len(sample))
        rows = []
        order, place, buckets = _dealt(h, n_buckets)
        for b, i, j in buckets:
            at = order[i:j]
            body, offs = words.gather(data, starts[sample[at]], ends[sample[at]] - starts[sample[at]])
            rows.append((b, chunk, WORDS, 0, 0, cluster.pack(np.array([i], np.int64), np.diff(offs).astype(np.uint32), trained[at].astype(np.uint32), body)))
        token = h[code]
        start, stop = runs_of(words.word_hashes(data, starts[sample], ends[sample], ANCHOR_KEYS)[code], per_doc)
        long = np.flatnonzero(stop - start > 1)
        phrase, number = np.unique(words.span_hash(words.prefix_sums(token, keys.base), start[long], stop[long], keys), return_inverse=True)
        counts = np.bincount(number[learnt[start[long]]], minlength=len(phrase))
        order, phrase_place, buckets = _dealt(phrase, n_buckets)
        for b, i, j in buckets:
            at = order[i:j]
            rows.append((b, chunk, PHRASES, 0, 0, cluster.pack(np.array([i], np.int64), phrase[at], counts[at].astype(np.uint32))))
        which = np.zeros(len(stop), np.uint32)
        which[long] = phrase_place[number] + 1
        texts = cluster.pack(ids, out, per_doc.astype(np.uint32), place[code].astype(np.uint32), np.array([len(sample), len(phrase)], np.int64), (stop - start).astype(np.uint32), which)
        rows.append((chunk % n_buckets, chunk, TEXTS, int(learnt[start].sum()), int((~out).sum()), texts))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["bucket", "chunk", "kind", "runs", "ends", "blob"])

    def run(batches):
        task = TaskContext.get().partitionId() << 24
        held, size, n = [], 0, 0
        for batch in batches:
            ids = cluster.ids_of(batch.column(0))
            for lo, hi, data, offs in words.text_parts(batch.column(1), SLICE_BYTES):
                data = words.LOWER[data]
                starts, ends, first = words.word_spans(data, offs)
                held.append((ids[lo:hi], data, starts, ends, np.diff(first)))
                size += len(data)
                if size >= chunk_bytes:
                    yield flush(held, task + n)
                    size, n = 0, n + 1
        if held:
            yield flush(held, task + n)
        cluster.release()

    return run


def _distinct(mine):
    """(bytes, offsets, sizes, one place of each distinct word, number of each word, training count) of a bucket's words."""
    sizes = np.concatenate([m[1] for m in mine]).astype(np.int64)
    data = np.concatenate([m[3] for m in mine])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    number, sample = words.distinct_words(data, offs[:-1])
    counts = np.bincount(number, weights=np.concatenate([m[2] for m in mine]), minlength=len(sample)).astype(np.int64)
    return data, offs, sizes, sample, number, counts


def marked(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(bytes, offsets) of words, the whitespace marker before each."""
    body, edge = words.gather(data, starts, sizes)
    out = np.empty(len(body) + 3 * len(starts), np.uint8)
    where = edge + 3 * np.arange(len(starts) + 1)
    out[np.arange(len(body)) + np.repeat(3 * np.arange(1, len(starts) + 1), np.diff(edge))] = body
    for k in range(3):
        out[where[:-1] + k] = MARK[k]
    return out, where


def _lexicon(key, table):
    """Of one bucket: its distinct training words."""
    data, offs, sizes, sample, _, counts = _distinct([cluster.unpack(b) for b in table.column("blob").to_pylist()])
    learnt = sample[counts > 0]
    body, _ = words.gather(data, offs[learnt], sizes[learnt])
    cluster.release()
    return pa.table({"blob": pa.array([cluster.pack(sizes[learnt].astype(np.uint32), body)], pa.binary())})


def _expected(shared, weights, lots: int):
    """One row a task: each piece's e over the words of its part of the lexicon, and its lot."""

    def run(batches):
        vocabulary = shared.value
        logp, log_byte = weights.value
        total = None
        for batch in batches:
            for blob in batch.column(0):
                sizes, data = cluster.unpack(blob.as_py())
                sizes = sizes.astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                for lo, hi in in_steps(sizes):
                    e = expected_pieces(vocabulary, logp, log_byte, *marked(data, starts[lo:hi], sizes[lo:hi]))
                    total = e if total is None else total + e
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % lots], pa.int32()), pa.array([cluster.pack(total)], pa.binary())], ["lot", "blob"])
        cluster.release()

    return run


def _total(blobs):
    total = 0.0
    for b in blobs:
        total = total + cluster.unpack(b.as_py())[0]
    return cluster.pack(total)


def _lot_total(key, table):
    return pa.table({"blob": pa.array([_total(table.column("blob"))], pa.binary())})


def expected_in(lexicon: DataFrame, vocabulary, weights) -> np.ndarray | None:
    """Each piece's e over all distinct training words; None without words.  The driver gets a vector a lot, square root of the tasks."""
    lots = 1 + math.isqrt(cluster.partitions(lexicon.sparkSession))
    got = lexicon.repartition(cluster.partitions(lexicon.sparkSession)).mapInArrow(_expected(vocabulary, weights, lots), "lot int, blob binary").groupBy("lot").applyInArrow(_lot_total, "blob binary").toArrow().column("blob")
    return cluster.unpack(_total(got))[0] if len(got) else None


def adapted(vocabulary: Vocabulary, e: np.ndarray | None, prior: float) -> tuple[np.ndarray, float]:
    """(log probability of each piece, of an unknown byte), given the expected pieces and what the first scores count for."""
    logp, log_byte = vocabulary.zipf()
    weight = prior * np.append(np.exp(logp), 256 * np.exp(log_byte))
    if e is not None:
        weight += e
    with np.errstate(divide="ignore"):
        out = np.log(weight) - np.log(weight.sum())
    return out[:-1], float(out[-1] - np.log(256))


def _answers(shared, weights):
    """Of one bucket: for each chunk its words' counts and log lattice probabilities, and its phrases' counts; totals."""

    def run(key, table):
        vocabulary = shared.value
        logp, log_byte = weights.value
        held = {WORDS: [], PHRASES: []}
        for c, k, b in zip(*(table.column(n).to_pylist() for n in ("chunk", "kind", "blob"))):
            held[k].append((c, cluster.unpack(b)))
        del table
        out, totals = [], [0, 0, 0]
        if held[WORDS]:
            data, offs, sizes, sample, number, counts = _distinct([m for _, m in held[WORDS]])
            spelled = np.empty(len(sample))
            for lo, hi in in_steps(sizes[sample]):
                at = sample[lo:hi]
                spelled[lo:hi] = log_marginal(vocabulary, logp, log_byte, *marked(data, offs[at], sizes[at]))
            upto = 0
            for c, (place, size, *_) in held[WORDS]:
                n = number[upto : upto + len(size)]
                upto += len(size)
                out.append((c, ANSWER, cluster.pack(place, counts[n].astype(np.uint32), spelled[n].astype(np.float32))))
            totals[:2] = int(counts.sum()), int((counts > 0).sum())
        if held[PHRASES]:
            _, number = np.unique(np.concatenate([m[1] for _, m in held[PHRASES]]), return_inverse=True)
            counts = np.bincount(number, weights=np.concatenate([m[2] for _, m in held[PHRASES]])).astype(np.int64)
            counts[counts < 2] = 0
            upto = 0
            for c, (place, h, _) in held[PHRASES]:
                n = number[upto : upto + len(h)]
                upto += len(h)
                out.append((c, COUNTS, cluster.pack(place, counts[n].astype(np.uint32))))
            totals[2] = int(counts.sum())
        out.append((-1, TOTALS, cluster.pack(np.array(totals, np.int64))))
        c, k, b = zip(*out)
        cluster.release()
        return pa.table({"chunk": pa.array(c, pa.int64()), "kind": pa.array(k, pa.int32()), "blob": pa.array(b, pa.binary())})

    return run


def _scores(n_words: int, n_distinct: int, n_phrases: int, n_runs: int, n_ends: int, concentration: float):
    total = n_words + n_ends
    distinct = n_distinct + (n_ends > 0)
    theta = n_phrases / (n_runs + 1)

    def run(key, table):
        held = {TEXTS: [], ANSWER: [], COUNTS: []}
        for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            held[k].append(cluster.unpack(b))
        ids, out, per_doc, place, (n_keys, n_kept), length, which = held[TEXTS][0]
        counts, spelled, phrases = np.zeros(n_keys, np.int64), np.zeros(n_keys), np.zeros(n_kept + 1, np.int64)
        for (at,), c, s in held[ANSWER]:
            counts[at : at + len(c)], spelled[at : at + len(c)] = c, s
        for (at,), c in held[COUNTS]:
            phrases[at + 1 : at + 1 + len(c)] = c
        edge = np.concatenate([[0], np.cumsum(per_doc.astype(np.int64))])

        def summed(values, edge=edge):
            run_of = np.concatenate([[0.0], np.cumsum(values)])
            return run_of[edge[1:]] - run_of[edge[:-1]]

        n = np.diff(edge) + 1
        floor = np.log10(total + 0.1 * (distinct + 1))
        base = summed(np.log10(counts + 0.1)[place]) + np.log10(n_ends + 0.1) - n * floor
        known = summed((counts > 0).astype(np.float64)[place]).round().astype(np.int64) + (n_ends > 0)
        with np.errstate(divide="ignore"):
            word, end = spelled, 0.0
            if total:
                word = np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0.0) / total), np.log(DISCOUNT * distinct / total) + spelled)
                end = float(np.log(n_ends / total))
            doc = np.repeat(np.arange(len(ids)), per_doc)
            order = np.argsort(doc * int(n_keys) + place, kind="stable")
            same = np.zeros(len(order), bool)
            same[1:] = (place[order][1:] == place[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            at = np.arange(len(order))
            seen = np.empty(len(order), np.int64)  # earlier occurrences of a token's word in its text
            seen[order] = at - np.maximum.accumulate(np.where(same, 0, at))
            token = np.logaddexp(np.log(concentration) + word[place], np.log(seen)) - np.log(concentration + at - edge[doc])
            stop = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
            arcs = np.log1p(-theta) + summed(token, stop)
            if theta:
                arcs = np.logaddexp(arcs, np.log(theta) + np.log(phrases / n_phrases)[which])
        score = summed(arcs, np.searchsorted(stop[:-1], edge)) + end + np.log(concentration) - np.log(concentration + n - 1)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == cluster.NULL_ID), "held_out": pa.array(out), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(ids), total), pa.int64()), "base_score": pa.array(base), "score": pa.array(score / np.log(10)), "lattice_score": pa.array(summed((spelled / np.log(10))[place]))})

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def score_documents(docs: DataFrame, model_path: str, concentration: float = 3000.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    Null and empty texts are their end alone.  Repeated rows count and are scored each.
    A null id counts as the text '' for the split.  Without training rows the pure
    lattice scores.  An empty table gives an empty result.  Other columns are not read.
    The vocabulary, tens of thousands of pieces whatever the input, is broadcast, and so
    is a weight for each piece.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_buckets = cluster.parts(spark, cluster.text_bytes(rows), BUCKET_BYTES)
    folder = cluster.shared_folder(spark)
    chunks = cluster.written(rows.mapInArrow(_chunks(words.Keys.new(), n_buckets), "bucket int, chunk long, kind int, runs long, ends long, blob binary"), folder, "chunks")
    lexicon = cluster.written(chunks.where(F.col("kind") == WORDS).select("bucket", "blob").groupBy("bucket").applyInArrow(_lexicon, "blob binary"), folder, "lexicon")
    weights = adapted(vocabulary.value, None, 1.0)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        weights = adapted(vocabulary.value, expected_in(lexicon, vocabulary, shared), PRIOR[k])
        shared.destroy()
    cluster.drop_folder(spark, f"{folder}/lexicon")
    weights = spark.sparkContext.broadcast(weights)
    asked = chunks.where(F.col("kind") != TEXTS).select("bucket", "chunk", "kind", "blob")
    answers = cluster.written(asked.groupBy("bucket").applyInArrow(_answers(vocabulary, weights), "chunk long, kind int, blob binary"), folder, "answers")
    texts = chunks.where(F.col("kind") == TEXTS)
    runs, ends = texts.agg(F.coalesce(F.sum("runs"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "phrases")]
    totals = answers.where(F.col("kind") == TOTALS).select("blob").mapInArrow(_totals, "n long, v long, phrases long").agg(*sums).first()
    together = texts.select("chunk", "kind", "blob").union(answers.where(F.col("kind") != TOTALS))
    return together.groupBy("chunk").applyInArrow(_scores(*map(int, totals), int(runs), int(ends), concentration), SCHEMA)


def _totals(batches):
    for batch in batches:
        got = np.array([cluster.unpack(b)[0] for b in batch.column(0).to_pylist()], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got.T], ["n", "v", "phrases"])
