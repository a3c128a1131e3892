"""What the operators need from a session: shared folders, sizes, packed rows."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver's Python ends.

    Where that is unset, a session in one process (as in tests) gets a temporary one;
    on a cluster this is an error, as executors do not share local folders.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_folder(spark, path)
    except Exception:  # the session ended before
        pass


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Into how many parts of about ``each`` bytes to deal ``size`` bytes: as many as shuffle partitions at least."""
    return max(partitions(spark), -(-size // each))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one pass over that column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def with_uid(docs: DataFrame) -> DataFrame:
    """Adds uid, a hash of doc_id and text: rows are told apart by both, so repeated or null ids cause no mix-up and no hot shard."""
    return docs.withColumn("uid", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def shard_of(uid: np.ndarray, n: int) -> np.ndarray:
    """Shard of each uid, as F.pmod(uid, n) has it in SQL."""
    return uid % n


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives memory that a worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def crc_mod(doc_id: str, n: int):
    """crc32 of the decimal text of an id, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary: byte planes, compressed where that helps."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        small = _C.compress(planes) if a.itemsize < 8 or a.dtype.kind == "i" else planes
        flag = len(small) < len(planes)
        body = small if flag else planes
        parts += [np.array([len(a), len(body), flag], np.int64).tobytes(), a.dtype.str.encode().ljust(4), body]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    view = memoryview(blob)
    while at < len(view):
        n, size, flag = np.frombuffer(view[at : at + 24], np.int64)
        kind = np.dtype(bytes(view[at + 24 : at + 28]).decode().strip())
        body = view[at + 28 : at + 28 + size]
        planes = _D.decompress(bytes(body)) if flag else body
        out.append(np.frombuffer(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.tobytes(), kind) if n else np.zeros(0, kind))
        at += 28 + int(size)
    return out


NULL_ID = np.iinfo(np.int64).min  # stands for a null document id, which sorts before all others


def ids_of(column) -> np.ndarray:
    """int64 ids of an Arrow column, null as NULL_ID."""
    return column.cast("int64").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def pack_places(docs: np.ndarray, uids: np.ndarray, places: np.ndarray, *more: np.ndarray) -> bytes:
    """(document, place) pairs, in rows' order: runs of ascending places of a document, and their gaps."""
    places = places.astype(np.int64)
    new = np.ones(len(docs), bool)
    new[1:] = (uids[1:] != uids[:-1]) | (docs[1:] != docs[:-1]) | (places[1:] <= places[:-1])
    first = np.flatnonzero(new)
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    counts = np.diff(np.append(first, len(docs)))
    return pack(np.diff(docs[first], prepend=0).astype(np.int64), uids[first].view(np.uint64), counts.astype(np.uint32), gaps.astype(np.uint32), *more)


def unpack_places(blob: bytes) -> list[np.ndarray]:
    """[docs, uids, places, *more]."""
    ids, uids, counts, gaps, *more = unpack(blob)
    counts = counts.astype(np.int64)
    total = np.cumsum(gaps.astype(np.int64))
    first = np.cumsum(counts) - counts
    base = np.repeat(total[first] - gaps[first], counts) if len(counts) else total
    return [np.repeat(np.cumsum(ids), counts), np.repeat(uids.view(np.int64), counts), total - base, *more]


def by_part(part: np.ndarray, n: int):
    """(part, positions with it, ascending) for each part that occurs; parts are below n."""
    order = np.argsort(part.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(k), order[edges[k] : edges[k + 1]]
