"""SentencePiece encoding and decoding with a unigram model.

Encoding puts a marker before the text, writes spaces as markers and takes the
segmentation with the greatest sum of log scores (Viterbi over a double-array
trie); characters that no piece covers fall back to byte pieces.  Decoding joins
pieces and bytes, turns markers into spaces and drops the first.

A best path always breaks before a run of markers and around white space that is
in no piece (Vocabulary.breaks), so what lies between is a unit, and each distinct
unit of a slice, told apart by its bytes, is segmented once.  Other vocabularies take
whole texts as units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import words
from larkspur.llm.lattice import MARK, Vocabulary, best_path


def _marked(data, starts, ends, opens):
    """(bytes, offsets) of units with markers for spaces, and one more before those that open a text."""
    body, edge = words.gather(data, starts, ends - starts)
    wide = np.where(body == 32, 3, 1)
    at = np.concatenate([[0], np.cumsum(wide)])
    offs = at[edge] + 3 * np.concatenate([[0], np.cumsum(opens)])
    shift = np.repeat(offs[:-1] + 3 * opens - at[edge[:-1]], np.diff(edge))
    at = at[:-1] + shift
    out = np.empty(offs[-1], np.uint8)
    plain = body != 32
    out[at[plain]] = body[plain]
    marks = np.concatenate([at[~plain], offs[:-1][opens]])
    for k in range(3):
        out[marks + k] = MARK[k]
    return out, offs


class Encoder:
    """Encodes slices of texts; keeps the ids of units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.breaks = vocabulary.breaks()
        self.cache = words.RaggedCache(lambda data, offs: best_path(vocabulary, data, offs))

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids, offsets) of the texts of a slice; an empty text has no ids."""
        n = len(data)
        opens = np.zeros(n + 1, bool)
        opens[offs[:-1][np.diff(offs) > 0]] = True
        begins = opens[:n].copy()
        if self.breaks is not None:
            hard, space = self.breaks[data], data == 32
            begins |= hard
            begins[1:] |= hard[:-1] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n) if len(starts) else starts
        code, sample = words.distinct_words(data, starts)
        # a unit that opens a text has a marker more: twice as many codes, those in use numbered anew
        code = 2 * code + opens[starts]
        used = np.zeros(2 * len(sample), bool)
        used[code] = True
        number = np.cumsum(used) - 1
        both = np.flatnonzero(used)
        code, sample = number[code], sample[both >> 1]
        at, size = self.cache.lookup(*_marked(data, starts[sample], ends[sample], (both & 1).astype(bool)))
        ids, edge = words.gather(self.cache.flat, at[code], size[code])
        return ids, edge[np.searchsorted(starts, offs)]


class Decoder:
    """Ids to bytes."""

    def __init__(self, vocabulary: Vocabulary):
        shown = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else b" \xe2\x81\x87 " if k == 3 else p.replace(MARK, b" ") for p, k in zip(vocabulary.pieces, vocabulary.kinds)]
        self.offs = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.data = np.frombuffer(b"".join(shown), np.uint8)
        self.opens = np.array([p.startswith(MARK) and k == 0 for p, k in zip(vocabulary.pieces, vocabulary.kinds)])

    def decode(self, ids: np.ndarray, offs: np.ndarray):
        """(bytes, offsets); the first marker of a text is dropped."""
        flat, edge = words.gather(self.data, self.offs[ids], self.offs[ids + 1] - self.offs[ids])
        edge = edge[offs]
        full = np.flatnonzero(np.diff(offs))
        drop = full[self.opens[ids[offs[full]]]]
        keep = np.ones(len(flat), bool)
        keep[edge[drop]] = False
        cut = np.zeros(len(offs), np.int64)
        cut[drop + 1] = 1
        return flat[keep], edge - np.cumsum(cut)


def _run(shared, decode: bool):
    def run(batches):
        encoder = words.of_worker(("pieces", shared.value.digest), lambda: Encoder(shared.value))
        decoder = Decoder(shared.value)
        fallback = shared.value.kinds == 1
        for batch in batches:
            for lo, hi, data, offs in words.text_parts(batch.column(1)):
                ids, edge = encoder.encode(data, offs)
                text, at = decoder.decode(ids, edge)
                same = np.array_equal(at, offs) and np.array_equal(text, data)
                exact = np.ones(hi - lo, bool) if same else np.array([text[at[i] : at[i + 1]].tobytes() == data[offs[i] : offs[i + 1]].tobytes() for i in range(hi - lo)])
                bytes_used = np.diff(np.concatenate([[0], np.cumsum(fallback[ids])])[edge])
                columns = {"doc_id": batch.column(0).slice(lo, hi - lo), "n_pieces": pa.array(np.diff(edge), pa.int64()), "n_byte_pieces": pa.array(bytes_used, pa.int64()), "exact": pa.array(exact), "ids": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))}
                if decode:
                    columns["decoded"] = pc.cast(words.strings(text, at, pa.binary()), pa.string(), safe=False)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per document: ids, their number, how many are bytes, and whether decoding gives the text again.

    Null and empty texts have no ids.  Only a text that holds the marker character
    itself decodes to another (a space there).  Repeated rows stay; other columns
    are not read.  The vocabulary, tens of thousands of pieces whatever the input,
    is read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, n_byte_pieces long, exact boolean, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(_run(shared, decoded), schema)
