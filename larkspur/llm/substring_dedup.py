"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``width`` consecutive words of one document.  A word goes if a window
that covers it has a word sequence that also starts in a document with a smaller
id.  Overlapping windows merge into maximal removal intervals.

1. Each task hashes every window of its documents.  Within a chunk of windows it
   keeps, for each hash, only the places in the smallest document: the others are
   settled already.  So a passage that a third of all documents share costs a few
   entries per chunk, not one per document.
2. The entries are dealt by hash to buckets, packed some 9 bytes each (a row of hash,
   id and place for each window would take some 40); a bucket finds the smallest
   document of each hash and the windows that come after it.
3. Those places and the documents meet by document shard, where intervals are
   merged and the kept words joined.

Hashes are Rabin-Karp polynomials modulo 2**61 - 1 at a secret point of each run, over
secret hashes of the words: no text can be made to collide, and among n windows about
n * n / 2**62 pairs agree by chance (0.004 in a table of 135 million windows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster, words

CHUNK = 1_500_000  # windows
BUCKET_BYTES = 8 << 20  # of text, for each bucket and each shard
ENTRY, SETTLED = 0, 1


def _chunk_rows(docs, uids, places, hashes, n_buckets, n_shards, salt):
    """Rows (bucket, kind, shard, blob) of one chunk of windows."""
    order = np.argsort(hashes)
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    d = docs[order]
    low = np.minimum.reduceat(d, first)
    settled = d > np.repeat(low, np.diff(np.append(first, len(h))))
    keep, gone = np.sort(order[~settled]), np.sort(order[settled])
    bucket = ((hashes[keep] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    for b, at in cluster.by_part(bucket, n_buckets):
        at = keep[at]
        yield b, ENTRY, -1, cluster.pack_places(docs[at], uids[at], places[at], hashes[at])
    for s, at in cluster.by_part(cluster.shard_of(uids[gone], n_shards), n_shards):
        at = gone[at]
        yield (s + salt) % n_buckets, SETTLED, s, cluster.pack_places(docs[at], uids[at], places[at])


def _as_batch(rows):
    bucket, kind, shard, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "shard", "blob"])


def _hash_windows(width: int, keys: words.Keys, n_buckets: int, n_shards: int, chunk: int = CHUNK):
    def run(batches):
        words.forget()
        held, n, salt = [], 0, 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return _as_batch(list(_chunk_rows(*columns, n_buckets, n_shards, salt)))

        for batch in batches:
            ids, uids = cluster.ids_of(batch.column(0)), cluster.ids_of(batch.column(1))
            for lo, hi, data, offs in words.text_parts(batch.column(2)):
                starts, ends, first = words.word_spans(data, offs)
                at, row, h = words.windows(words.word_hashes(data, starts, ends, keys), first, width, keys)
                if not len(at):
                    continue
                held.append((ids[lo:hi][row], uids[lo:hi][row], (at - first[row]).astype(np.int32), h))
                n += len(at)
                if n >= chunk:
                    yield flush()
                    n, salt = 0, salt + 7
        if n:
            yield flush()
        cluster.release()

    return run


def _repeats(n_shards: int):
    """Of one bucket: the places whose hash starts in a smaller document, and what was settled before."""

    def run(key, table):
        kinds, shards = table.column("kind").to_numpy(), table.column("shard").to_numpy()
        blobs = table.column("blob").to_pylist()
        del table
        out = [(int(s), b) for b, k, s in zip(blobs, kinds, shards) if k == SETTLED]
        entries = [cluster.unpack_places(b) for b, k in zip(blobs, kinds) if k == ENTRY]
        if entries:
            docs, uids, places, hashes = (np.concatenate(x) for x in zip(*entries))
            del entries, blobs
            order = np.argsort(hashes)
            h = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            d = docs[order]
            low = np.minimum.reduceat(d, first)
            at = order[d > np.repeat(low, np.diff(np.append(first, len(h))))]
            at = at[np.lexsort((places[at], uids[at]))]
            for s, x in cluster.by_part(cluster.shard_of(uids[at], n_shards), n_shards):
                x = at[x]
                out.append((s, cluster.pack_places(docs[x], uids[x], places[x])))
        shard, blob = zip(*out) if out else ((), ())
        cluster.release()
        return pa.table({"shard": pa.array(shard, pa.int32()), "blob": pa.array(blob, pa.binary())})

    return run


def places_of(table, ids: np.ndarray, uids: np.ndarray):
    """(row, place, more) of a shard's blobs: a row for each document of that id and uid."""
    blobs = [cluster.unpack_places(b) for b in table.column("blob").to_pylist()]
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    docs, marks, places, *more = (np.concatenate(x) for x in zip(*blobs))
    order = np.argsort(uids, kind="stable")
    lo = np.searchsorted(uids[order], marks, "left")
    n = np.searchsorted(uids[order], marks, "right") - lo
    back = np.repeat(np.arange(len(docs)), n)
    rows = order[lo[back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)]
    same = ids[rows] == docs[back]
    rows, back = rows[same], back[same]
    return rows, places[back], [m[back] for m in more]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions below n that lie in some [start, end)."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def _remove(width: int, verbatim: bool):
    def run(key, docs, repeats):
        ids, uids = (cluster.ids_of(docs.column(c).combine_chunks()) for c in ("doc_id", "uid"))
        rows, places, _ = places_of(repeats, ids, uids)
        order = np.argsort(rows, kind="stable")
        rows, places = rows[order], places[order]
        text = docs.column("text").combine_chunks()
        out = []
        for lo, hi, data, offs in words.text_parts(text):
            starts, ends, first = words.word_spans(data, offs)
            a, b = np.searchsorted(rows, [lo, hi])
            at = places[a:b] + first[rows[a:b] - lo]
            stop = np.minimum(at + width, first[rows[a:b] - lo + 1])
            at, stop = at[at < stop], stop[at < stop]
            gone = covered(at, stop, len(starts))
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            removed = np.bincount(row[gone], minlength=hi - lo)
            kept = np.flatnonzero(~gone)
            # kept words, each followed by a space but for a document's last
            spaced = np.append(data, np.uint8(32))
            length = ends[kept] - starts[kept] + 1
            flat, at_word = words.gather(np.append(spaced, np.uint8(32)), starts[kept], length)
            flat[at_word[1:] - 1] = 32
            edge = at_word[np.searchsorted(row[kept], np.arange(hi - lo + 1))]
            tail = np.zeros(len(flat), bool)
            tail[edge[1:][np.diff(edge) > 0] - 1] = True
            flat = flat[~tail]
            edge = edge - np.cumsum(np.concatenate([[0], np.diff(edge) > 0]))
            # maximal intervals of removed words
            edges = np.diff(gone.astype(np.int8), prepend=0, append=0) if len(gone) else np.zeros(1, np.int8)
            inner = first[(first > 0) & (first < len(gone))]
            inner = inner[gone[inner] & gone[inner - 1]]
            begin = np.sort(np.concatenate([np.flatnonzero(edges == 1), inner]))
            end = np.sort(np.concatenate([np.flatnonzero(edges == -1), inner]))
            who = row[begin] if len(begin) else begin
            span = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first[who], pa.int64()), pa.array(end - first[who], pa.int64())], ["start", "stop"]))
            out.append(pa.table({"doc_id": docs.column("doc_id").combine_chunks()[lo:hi].cast("int64"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "intervals": span, "kept_text": words.strings(flat, edge)}))
            if verbatim:
                out[-1] = out[-1].set_column(4, "kept_text", pc.if_else(pa.array(removed == 0), text[lo:hi].cast(pa.string()), out[-1].column("kept_text").combine_chunks()))
            if "rest" in docs.column_names:
                out[-1] = out[-1].append_column("rest", docs.column("rest").combine_chunks()[lo:hi])
        cluster.release()
        return pa.concat_tables(out)

    return run


SCHEMA = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,stop:long>>, kept_text string"


def dedup_substrings(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", rest: str | None = None, verbatim: bool = False) -> DataFrame:
    """One row per document: n_words, n_removed, intervals of removed words, kept_text (kept words joined by a space).

    Null or empty texts, and texts shorter than a window, lose nothing.  A null id
    counts as the smallest, so rows without one lose nothing.  Rows that repeat an id do
    not remove each other's words.  An empty table gives an empty result.  A column named
    as ``rest`` is passed on under that name; others are not read.  With ``verbatim`` a
    text that loses nothing is passed on as it is (null stays null).
    """
    spark = docs.sparkSession
    schema = SCHEMA + (f", rest {docs.schema[rest].dataType.simpleString()}" if rest else "")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(rest).alias("rest")] if rest else []))
    n_shards = n_buckets = cluster.parts(spark, cluster.text_bytes(docs), BUCKET_BYTES)  # at most n_buckets * n_shards small rows go back
    docs = cluster.with_uid(docs)
    entries = docs.select("doc_id", "uid", "text").mapInArrow(_hash_windows(width, words.Keys.new(), n_buckets, n_shards), "bucket int, kind int, shard int, blob binary")
    repeats = entries.groupBy("bucket").applyInArrow(_repeats(n_shards), "shard int, blob binary")
    shards = docs.withColumn("shard", F.pmod("uid", F.lit(n_shards)).cast("int"))
    return shards.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(_remove(width, verbatim), schema)
