"""Token ids in compressed blocks, in ascending order of document.

A store is a folder of three tables: ``symbols`` (id, freq: the frequency table
all blocks share), ``blocks`` (shard, block, first: ids of the shard before it,
n_tokens, payload) and ``shards`` (shard, start: ids of all shards before it).
A payload is a header (documents, their ids and lengths) and the block's tokens
under rans.Coder, with checkpoints and checksums.  Blocks hold whole documents, about
BLOCK ids; each is read alone, so reading is as parallel as there are blocks.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import cluster, words
from larkspur.llm.rans import Coder, Table

BLOCK = 1 << 16
SHARD_BYTES = 64 << 20  # of text, for each run of documents that is sorted and written together
SLICE_BYTES = 4 << 20
TOGETHER = 8  # blocks that are coded side by side


def drops_white_space(tokenizer_json: str) -> bool:
    """Whether a tokenizer splits at white space and drops it, so that a text's ids are its words' ids."""
    steps = json.loads(tokenizer_json).get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    return bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True


def splits_at_letters(tokenizer_json: str) -> bool:
    """Whether it also lower-cases and never joins letters with other signs, but for apostrophes."""
    made = json.loads(tokenizer_json)
    pattern = made["pre_tokenizer"].get("pretokenizers", [made["pre_tokenizer"]])[0]["pattern"].get("Regex", "")
    lower = any(n.get("type") == "Lowercase" for n in (made.get("normalizer") or {}).get("normalizers", []))
    return lower and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and made["model"].get("end_of_word_suffix") == "</w>"


LETTER, SIGN, OTHER = 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)  # 0 for separators
KIND[:128] = SIGN
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[words.SEPARATOR] = 0


def letter_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(lower-cased bytes, starts, ends) of words cut between ASCII letters and other ASCII signs.

    Words with an apostrophe or "<" stay whole and as they are, for contractions and special tokens.
    """
    low = words.LOWER[data]
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = kind[1:] * kind[:-1] == LETTER * SIGN
    odd = np.flatnonzero((data == 39) | (data == 60))
    if len(odd):
        whole = np.unique(np.searchsorted(starts, odd, "right") - 1)
        size = (ends - starts)[whole]
        at = np.repeat(starts[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
        low[at] = data[at]
        cut[at] = False
    cut[starts] = True
    begin = np.flatnonzero(cut[:-1])
    close = np.append(begin[1:], len(data))
    return low, begin, np.minimum(close, ends[np.searchsorted(starts, begin, "right") - 1]) if len(begin) else close[:0]


class BatchTokenizer:
    """Encodes slices of texts with a tokenizer; keeps the ids of word parts it has met, if ids go by words."""

    MOST = 1_000_000

    def __init__(self, tokenizer_json: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word = drops_white_space(tokenizer_json)
        self.by_letters = self.by_word and splits_at_letters(tokenizer_json)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache = words.RaggedCache(self.of_parts, self.MOST)

    def of_texts(self, texts: list[str]):
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, size.sum())
        return flat, np.concatenate([[0], np.cumsum(size)])

    def of_parts(self, data: np.ndarray, offs: np.ndarray):
        texts = words.strings(data, offs).to_pylist()
        bare = np.concatenate([[0], np.cumsum(KIND[data] != LETTER)])
        bare = (bare[offs[1:]] == bare[offs[:-1]]) & self.by_letters
        easy, hard = np.flatnonzero(bare), np.flatnonzero(~bare)
        joined = [texts[k] for k in easy]  # runs of letters: each ends with the one token that closes a word
        flat, _ = self.of_texts([" ".join(joined[k : k + 400]) for k in range(0, len(joined), 400)])
        edge = np.concatenate([[0], np.flatnonzero(self.closes[flat]) + 1])
        if len(edge) != len(easy) + 1:
            return self.of_texts(texts)
        other, other_edge = self.of_texts([texts[k] for k in hard])
        begin, size = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        begin[easy], size[easy] = edge[:-1], np.diff(edge)
        begin[hard], size[hard] = other_edge[:-1] + len(flat), np.diff(other_edge)
        return words.gather(np.concatenate([flat, other]), begin, size)

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids, offsets) of the texts of a slice."""
        if not self.by_word:
            return self.of_texts(words.strings(data, offs).to_pylist())
        starts, ends, _ = words.word_spans(data, offs)
        if self.by_letters:
            data, starts, ends = letter_units(data, starts, ends)
        code, sample = words.distinct_words(data, starts, ends)
        at, size = self.cache.lookup(*words.gather(data, starts[sample], (ends - starts)[sample]))
        ids, edge = words.gather(self.cache.flat, at[code], size[code])
        return ids, edge[np.searchsorted(starts, offs)]


IDS, COUNT = 0, 1


def _tokenize(shared, end_id: int):
    """Rows (IDS, doc_id, number of ids, ids, their width), and at a task's end (COUNT, id, n) for each id it met."""

    def run(batches):
        tokenizer = words.of_worker(("tokenizer", shared.value), lambda: BatchTokenizer(shared.value))
        names = ["kind", "doc_id", "n_tokens", "ids", "width"]
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for lo, hi, data, offs in words.text_parts(batch.column(1), SLICE_BYTES):
                ids, edge = tokenizer.encode(data, offs)
                full = np.insert(ids, edge[1:], end_id).astype("<u4")
                got = np.bincount(full, minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
                edge = (edge + np.arange(len(edge))) * 2
                small = full.astype("<u2") if full.max(initial=0) < 1 << 16 else full
                edge = edge * (small.itemsize // 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, IDS, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(edge) // small.itemsize, pa.int64()), words.strings(np.frombuffer(small.tobytes(), np.uint8), edge, pa.binary()), pa.array(np.full(hi - lo, small.itemsize, np.int32))], names)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), COUNT, np.int32)), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int32())], names)
        cluster.release()

    return run


def _ids(table) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2" if w == 2 else "<u4") for b, w in zip(table.column("ids").to_pylist(), table.column("width").to_pylist())]


def _blocks(shared):
    def run(batches):
        coder = Coder(Table(*shared.value))
        shard = TaskContext.get().partitionId()
        held, sizes, done = [], 0, 0
        number = 0
        waiting: list[list[tuple[int, np.ndarray]]] = []

        def flush():
            nonlocal number, done
            tokens = [np.concatenate([ids for _, ids in docs]) for docs in waiting]
            rows = []
            for docs, all_ids, payload in zip(waiting, tokens, coder.encode(tokens)):
                head = cluster.pack(np.array([d for d, _ in docs], np.int64), np.array([len(i) for _, i in docs], np.uint32))
                rows.append((shard, number, done, len(all_ids), len(head).to_bytes(8, "little") + head + payload))
                number += 1
                done += len(all_ids)
            a, b, c, d, e = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.binary())], ["shard", "block", "first", "n_tokens", "payload"])

        for batch in batches:
            for doc, ids in zip(cluster.ids_of(batch.column(0)).tolist(), _ids(batch)):
                held.append((doc, ids))
                sizes += len(ids)
                if sizes >= BLOCK:
                    waiting.append(held)
                    held, sizes = [], 0
                    if len(waiting) == TOGETHER or sum(len(i) for _, i in waiting[-1]) > 4 * BLOCK:
                        yield flush()
                        waiting = []
        if held:
            waiting.append(held)
        if waiting:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, end each with end_id and write the store; null and empty texts are their end id alone.

    Documents come in ascending order of id, null ids first; rows that share an id
    follow each other by a hash of their content.  An empty table makes an empty store.  Other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    temp = cluster.shared_folder(spark)
    size = cluster.text_bytes(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    coded = cluster.written(rows.mapInArrow(_tokenize(shared, end_id), "kind int, doc_id long, n_tokens long, ids binary, width int"), temp, "coded")
    counts = coded.where(F.col("kind") == COUNT).groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_tokens").alias("n")).toArrow()
    table = Table.of(counts.column("id").to_numpy(), counts.column("n").to_numpy())
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.freq)], "id long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/symbols")
    frequencies = spark.sparkContext.broadcast((table.symbols, table.freq))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]  # rows without an id are dealt out too
    ordered = coded.where(F.col("kind") == IDS).drop("kind").repartitionByRange(cluster.parts(spark, size, SHARD_BYTES), *order[:2]).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(frequencies), "shard int, block long, first long, n_tokens long, payload binary")
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")
    cluster.drop_folder(spark, temp)


def _decode(shared, starts, with_ids: bool):
    def run(batches):
        coder = Coder(Table(*shared.value))
        begin = dict(starts)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                payloads = part.column("payload").to_pylist()
                cut = [int.from_bytes(p[:8], "little") + 8 for p in payloads]
                tokens = coder.decode([p[c:] for p, c in zip(payloads, cut)])
                for p, c, ids, shard, first in zip(payloads, cut, tokens, part.column("shard").to_pylist(), part.column("first").to_pylist()):
                    docs, sizes = cluster.unpack(p[8:c])
                    edge = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                    columns = {"doc_id": pa.array(docs, pa.int64(), mask=docs == cluster.NULL_ID), "start": pa.array(edge[:-1] + begin[shard] + first, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    table = spark.read.parquet(f"{folder}/symbols").orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), table.column("freq").to_numpy()))
    starts = [(r.shard, r.start) for r in spark.read.parquet(f"{folder}/shards").collect()]  # a row for each shuffle partition
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.parquet(f"{folder}/blocks").select("shard", "first", "payload").mapInArrow(_decode(shared, starts, with_ids), schema)
