"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion.

Removes every byte covered by a string of ``width`` bytes that also starts
elsewhere, in the same document or another.

Candidates.  The anchor of a window of ``width`` bytes is its least 32-byte gram by
hash, the leftmost of equal ones; equal windows have equal anchors at equal offsets.
Neighbouring windows share their anchor, so a document falls into runs of windows,
one per anchor, about one for 85 bytes.  Only runs whose anchor occurs twice can hold
repeated windows.  Their contexts (the bytes their windows span) meet by anchor.

Decision.  Of the distinct contexts of a bucket, with their multiplicities, windows
whose rolling hash occurs once are dropped; equal windows have equal hashes.  Over what
is left a suffix array and the Burrows-Wheeler transform are built.  Breadth-first
backward extension of intervals, one letter a level, sets longest common prefixes in
ascending order of value (Beller et al., 2013) and stops at ``width``: boundaries not
set by then separate suffixes with a common prefix of at least that.  A class of
suffixes that counts two or more occurrences is repeated; hashes decide nothing.

Equal contexts are one context, combined within a slice before they are dealt.  A
context that a slice holds twice or more counts as two there and its places are
settled, as all its windows occur twice; so a passage in a third of all documents is
one string a slice, without a list of its places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import cluster, words
from larkspur.llm.substring_dedup import ENTRY, SETTLED, covered, places_of

GRAM = 32
CHUNK = 250_000  # anchors
BUCKET_BYTES, CONTEXT_BYTES = 4 << 20, 1 << 20  # of text, for each bucket or shard, and for each suffix array
MULT = 0x9E3779B97F4A7C15

_ROLL: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _rolling(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash modulo 2**64 of values[start:start+width]: equal runs have equal hashes, nothing else is asked of it."""
    n = len(values) + 1
    if len(_ROLL[0]) < n:
        for k, mult in enumerate((MULT, pow(MULT, -1, 1 << 64))):
            _ROLL[k] = np.full(n, mult, np.uint64)
            _ROLL[k][0] = 1
            np.cumprod(_ROLL[k], out=_ROLL[k])
    power, back = _ROLL[0], _ROLL[1]
    sums = np.zeros(n, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: n - 1], out=sums[1:])
    raw = (sums[starts + width] - sums[starts]) * back[starts]
    if n > 4 * words.SLICE_BYTES:
        _ROLL[:] = [np.ones(1, np.uint64)] * 2
    return words.mix(raw)


def anchored_runs(data: np.ndarray, offs: np.ndarray, width: int):
    """(row, first window, windows - 1, anchor's hash) of each run of windows with one anchor."""
    gram = min(GRAM, width)
    n, w = len(data), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    h = _rolling(data, at, gram)
    bits = np.uint64(max(24, int(n).bit_length()))
    least = ((h >> bits) << bits) | at.astype(np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(np.repeat(offs[1:], np.diff(offs)) - np.arange(n) >= width)
    anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start))) - 1
    at = start[first]
    return row[at], at - offs[row[at]], length, h[anchor[first]]


def _anchors(width: int, n_buckets: int, n_shards: int):
    def flush(held, salt):
        docs, uids, place, length, h = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.diff(np.append(first, len(h)))
        many = np.zeros(len(h), bool)
        many[order] = np.repeat(count > 1, count)
        sent = np.sort(order[first])  # one of each anchor; those of more than one are settled, and only tell the others
        rows = []
        for b, at in cluster.by_part(((h[sent] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
            at = sent[at]
            rows.append((b, ENTRY, -1, cluster.pack_places(docs[at], uids[at], place[at], length[at].astype(np.uint32), many[at], h[at])))
        at = np.flatnonzero(many)
        for s, x in cluster.by_part(cluster.shard_of(uids[at], n_shards), n_shards):
            x = at[x]
            rows.append(((s + salt) % n_buckets, SETTLED, s, cluster.pack_places(docs[x], uids[x], place[x], length[x].astype(np.uint32), h[x])))
        b, k, s, blob = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "shard", "blob"])

    def run(batches):
        held, total, salt = [], 0, 0
        for batch in batches:
            ids, uids = cluster.ids_of(batch.column(0)), cluster.ids_of(batch.column(1))
            for lo, hi, data, offs in words.text_parts(batch.column(2)):
                row, place, length, h = anchored_runs(data, offs, width)
                if len(row):
                    held.append((ids[lo:hi][row], uids[lo:hi][row], place, length, h))
                    total += len(row)
                if total > CHUNK:
                    yield flush(held, salt)
                    held, total, salt = [], 0, salt + 7
        if total:
            yield flush(held, salt)
        cluster.release()

    return run


def _shared_anchors(n_shards: int):
    def run(key, table):
        kinds, shards, blobs = table.column("kind").to_numpy(), table.column("shard").to_numpy(), table.column("blob").to_pylist()
        out = [(int(s), b) for b, k, s in zip(blobs, kinds, shards) if k == SETTLED]
        entries = [cluster.unpack_places(b) for b, k in zip(blobs, kinds) if k == ENTRY]
        if entries:
            docs, uids, place, length, many, h = (np.concatenate(x) for x in zip(*entries))
            _, at, count = np.unique(h, return_inverse=True, return_counts=True)
            told = np.bincount(at, weights=many) > 0
            take = np.flatnonzero(((count > 1) | told)[at] & ~many)
            take = take[np.lexsort((place[take], uids[take]))]
            for s, x in cluster.by_part(cluster.shard_of(uids[take], n_shards), n_shards):
                x = take[x]
                out.append((s, cluster.pack_places(docs[x], uids[x], place[x], length[x], h[x])))
        s, b = zip(*out) if out else ((), ())
        cluster.release()
        return pa.table({"shard": pa.array(s, pa.int32()), "blob": pa.array(b, pa.binary())})

    return run


def _contexts(width: int, n_buckets: int):
    def run(key, docs, anchors):
        ids, uids = (cluster.ids_of(docs.column(c).combine_chunks()) for c in ("doc_id", "uid"))
        rows, place, more = places_of(anchors, ids, uids)
        out, done = [], []
        if len(rows):
            length, h = more
            length = length.astype(np.int64)
            order = np.lexsort((place, rows))
            keep = np.ones(len(order), bool)
            keep[1:] = (rows[order][1:] != rows[order][:-1]) | (place[order][1:] != place[order][:-1])
            order = order[keep]
            rows, place, length, h = rows[order], place[order], length[order], h[order]
            for lo, hi, data, offs in words.text_parts(docs.column("text").combine_chunks()):
                a, b = np.searchsorted(rows, [lo, hi])
                row, at, long, key_ = rows[a:b] - lo, place[a:b], length[a:b], h[a:b]
                fits = at + long + width <= np.diff(offs)[row]
                row, at, long, key_ = row[fits], at[fits], long[fits], key_[fits]
                if not len(row):
                    continue
                begin, span = offs[row] + at, long + width
                own, marks = ids[lo:hi][row], uids[lo:hi][row]
                for bucket, x in cluster.by_part(((key_ >> np.uint64(12)) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                    seen: dict[bytes, int] = {}
                    which = np.fromiter((seen.setdefault(data[s : s + l].tobytes(), len(seen)) for s, l in zip(begin[x].tolist(), span[x].tolist())), np.int64, len(x))
                    sizes = np.fromiter(map(len, seen), np.uint32, len(seen))
                    count = np.bincount(which, minlength=len(seen))
                    open_ = count[which] == 1
                    y = x[open_]
                    out.append((bucket, -1, cluster.pack(sizes, np.minimum(count, 2).astype(np.uint8), np.frombuffer(b"".join(seen), np.uint8)), cluster.pack_places(own[y], marks[y], at[y], which[open_].astype(np.uint32))))
                    done.append(x[~open_])
                if any(map(len, done)):
                    y = np.sort(np.concatenate(done))
                    out.append(((int(key[0].as_py()) + lo) % n_buckets, int(key[0].as_py()), None, cluster.pack_places(own[y], marks[y], at[y], span[y].astype(np.uint32))))
                    done.clear()
        b, s, c, p = zip(*out) if out else ((), (), (), ())
        cluster.release()
        return pa.table({"bucket": pa.array(b, pa.int32()), "shard": pa.array(s, pa.int32()), "contexts": pa.array(c, pa.binary()), "places": pa.array(p, pa.binary())})

    return run


def suffix_array(text: np.ndarray, depth: int):
    """(suffix array, ranks), in order of the first ``depth`` symbols at least; symbols are below 512.

    Prefix doubling: suffixes that are alone in their group are in place, only the others are sorted again.
    """
    n = len(text)
    symbols = np.unique(text)
    if len(symbols) < 256:  # as bytes, 8 to a key
        codes = np.zeros(512, np.uint8)
        codes[symbols] = np.arange(1, len(symbols) + 1)
        padded = np.append(codes[text], np.zeros(8, np.uint8))
        key, h = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64), 8
    else:
        padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
        key, h = np.zeros(n, np.uint64), 7
        for j in range(7):
            key = (key << np.uint64(9)) | padded[j : n + j]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)  # a group's first place in the order, for all its suffixes

    def alone(new):
        """Whether each of some sorted suffixes differs from both neighbours."""
        return new & np.append(new[1:], True)

    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    place = place[~alone(new)]  # places in the order that are not settled
    while len(place) and h < depth:
        some = order[place]
        group = rank[some]
        after = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        key = (group << 32) | after
        turn = np.argsort(key)
        some, key = some[turn], key[turn]
        order[place] = some  # groups lie in ascending places, so this keeps them there
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank[some] = np.maximum.accumulate(np.where(new, place, 0))
        place = place[~alone(new)]
        h *= 2
    rank[order] = np.arange(n)
    return order, rank


def unset_boundaries(text: np.ndarray, order: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Whether the common prefix of suffixes j - 1 and j reaches ``width``; 0 in text separates contexts.

    Backward extension by levels: an interval of suffixes that start with a string
    gives those of each letter before it; one whose right boundary is new sets it.
    """
    n = len(text)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    before = np.zeros(n, text.dtype)  # the transform: the symbol before each suffix
    before[order > 0] = text[order[order > 0] - 1]
    back = np.zeros(n, np.int64)  # and the suffix that begins with it
    back[order > 0] = rank[order[order > 0] - 1]
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(width):
        if not len(lo):
            break
        size = hi - lo
        interval = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(interval)) + np.repeat(lo - (np.cumsum(size) - size), size)
        inner = before[at] > 0
        at, interval = at[inner], interval[inner]
        if not len(at):
            break
        q = back[at]
        turn = np.argsort(q)
        q, letter, interval = q[turn], before[at[turn]], interval[turn]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1] + 1) | (interval[1:] != interval[:-1]) | (letter[1:] != letter[:-1])
        first = np.flatnonzero(new)
        lo, hi = q[first], q[np.append(first[1:], len(q)) - 1] + 1
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi] = False
    return unset[:n]


def candidates(sizes: np.ndarray, data: np.ndarray, times: np.ndarray, width: int):
    """(context, first offset, bytes) of the runs of windows whose hash counts two or more occurrences."""
    offs = np.concatenate([[0], np.cumsum(sizes)])
    room = np.maximum(sizes - width + 1, 0)
    context = np.repeat(np.arange(len(sizes)), room)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(room) - room, room)
    h = _rolling(data, offs[context] + offset, width)
    order = np.argsort(h)
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[context[order]], first) if len(first) else first
    hit = np.sort(order[np.repeat(total > 1, np.diff(np.append(first, len(h))))])
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (context[hit[1:]] != context[hit[:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(hit))) + width - 1
    return context[hit[begin]], offset[hit[begin]], length


def repeated_windows(sizes: np.ndarray, data: np.ndarray, times: np.ndarray, width: int):
    """(context, offset) of each window of the distinct contexts that occurs twice or more, ascending."""
    offs = np.concatenate([[0], np.cumsum(sizes)])
    whole_of, skipped, sizes = candidates(sizes, data, times, width)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, _ = words.gather(data, offs[whole_of] + skipped, sizes)
    times = times[whole_of]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    run = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(data) + len(sizes), np.int16)
    text[np.arange(len(data)) + run] = data.astype(np.int16) + 1
    order, rank = suffix_array(text, width)
    unset = unset_boundaries(text, order, rank, width)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(text)) - (offs[:-1] + np.arange(len(sizes)))[owner]
    whole = (offset + width <= sizes[owner])[order]
    group = np.cumsum(~unset)
    total = np.bincount(group[whole], weights=times[owner[order[whole]]], minlength=int(group[-1]) + 1)
    hit = np.sort(order[whole][total[group[whole]] > 1])
    return whole_of[owner[hit]], offset[hit] + skipped[owner[hit]]


def _decide(width: int, n_shards: int):
    def run(key, table):
        seen: dict[bytes, int] = {}
        docs, uids, places, which, held, out = [], [], [], [], [], []
        for s, c, p in zip(*(table.column(n).to_pylist() for n in ("shard", "contexts", "places"))):
            if c is None:
                out.append((s, p))
                continue
            sizes, count, data = cluster.unpack(c)
            edge = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            raw = data.tobytes()
            number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())])
            held.append((number, count))
            d, u, at, local = cluster.unpack_places(p)
            docs.append(d)
            uids.append(u)
            places.append(at)
            which.append(number[local])
        context = np.zeros(0, np.int64)
        if seen:
            docs, uids, places, which = np.concatenate(docs), np.concatenate(uids), np.concatenate(places), np.concatenate(which)
            number, count = (np.concatenate(x) for x in zip(*held))
            times = np.bincount(number, weights=count, minlength=len(seen)).astype(np.int64)
            sizes = np.fromiter(map(len, seen), np.int64, len(seen))
            context, offset = repeated_windows(sizes, np.frombuffer(b"".join(seen), np.uint8), times, width)
        if len(context):
            new = np.ones(len(context), bool)
            new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
            first = np.flatnonzero(new)
            length = offset[np.append(first[1:], len(offset)) - 1] - offset[first] + width
            context, offset = context[first], offset[first]
            low = np.searchsorted(context, which, "left")
            n = np.searchsorted(context, which, "right") - low
            back = np.repeat(np.arange(len(which)), n)
            span = low[back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
            docs, uids, begin, length = docs[back], uids[back], places[back] + offset[span], length[span]
            order = np.lexsort((begin, uids))
            docs, uids, begin, length = docs[order], uids[order], begin[order], length[order]
            for s, x in cluster.by_part(cluster.shard_of(uids, n_shards), n_shards):
                out.append((s, cluster.pack_places(docs[x], uids[x], begin[x], length[x].astype(np.uint32))))
        s, b = zip(*out) if out else ((), ())
        cluster.release()
        return pa.table({"shard": pa.array(s, pa.int32()), "blob": pa.array(b, pa.binary())})

    return run


def _cut(key, docs, spans):
    ids, uids = (cluster.ids_of(docs.column(c).combine_chunks()) for c in ("doc_id", "uid"))
    rows, begin, more = places_of(spans, ids, uids)
    length = more[0].astype(np.int64) if more else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    rows, begin, length = rows[order], begin[order], length[order]
    out = []
    for lo, hi, data, offs in words.text_parts(docs.column("text").combine_chunks()):
        a, b = np.searchsorted(rows, [lo, hi])
        row = rows[a:b] - lo
        start = np.minimum(offs[row] + begin[a:b], offs[row + 1])
        gone = covered(start, np.minimum(start + length[a:b], offs[row + 1]), len(data))
        kept = np.concatenate([[0], np.cumsum(~gone)])[offs]
        size = np.diff(offs)
        edges = np.diff(gone.astype(np.int8), prepend=0, append=0) if len(gone) else np.zeros(1, np.int8)
        inner = np.unique(offs[(offs > 0) & (offs < len(data))])
        inner = inner[gone[inner] & gone[inner - 1]]
        first = np.sort(np.concatenate([np.flatnonzero(edges == 1), inner]))
        last = np.sort(np.concatenate([np.flatnonzero(edges == -1), inner]))
        who = np.searchsorted(offs, first, "right") - 1
        span = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(first - offs[who], pa.int64()), pa.array(last - offs[who], pa.int64())], ["start", "stop"]))
        out.append(pa.table({"doc_id": docs.column("doc_id").combine_chunks()[lo:hi].cast("int64"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - np.diff(kept), pa.int64()), "spans": span, "kept": words.strings(data[~gone], kept, pa.binary())}))
    cluster.release()
    return pa.concat_tables(out)


def dedup_bytes(docs: DataFrame, width: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_removed, spans (maximal removed runs), kept (the remaining bytes).

    Null is an empty text; texts shorter than ``width`` lose nothing.  Rows that repeat
    an id, null ids too, are documents like others.  An empty table gives an empty result.
    Cutting may split a character, so kept is binary.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = cluster.text_bytes(docs)
    n_buckets = n_shards = cluster.parts(spark, size, BUCKET_BYTES)
    docs = cluster.with_uid(docs)
    entries = docs.select("doc_id", "uid", "text").mapInArrow(_anchors(width, n_buckets, n_shards), "bucket int, kind int, shard int, blob binary")
    anchors = entries.groupBy("bucket").applyInArrow(_shared_anchors(n_shards), "shard int, blob binary")
    shards = docs.withColumn("shard", F.pmod("uid", F.lit(n_shards)).cast("int"))
    contexts = shards.groupBy("shard").cogroup(anchors.groupBy("shard")).applyInArrow(_contexts(width, cluster.parts(spark, size, CONTEXT_BYTES)), "bucket int, shard int, contexts binary, places binary")
    spans = contexts.groupBy("bucket").applyInArrow(_decide(width, n_shards), "shard int, blob binary")
    return shards.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
