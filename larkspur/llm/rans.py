"""Static range asymmetric numeral system, many lanes side by side.

Token i of a block belongs to lane i % LANES; every lane has a 63-bit state and
all lanes of a block share one stream of 32-bit words.  A block is decoded alone.
It holds the lanes' states at each checkpoint, so decoding can also begin inside.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 256
EVERY = 128  # steps from checkpoint to checkpoint
LOW = np.uint64(1 << 31)
MAGIC = 0x314B524C
U32, UB, MASK = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)


@dataclass(frozen=True)
class Table:
    """Symbols in ascending order with frequencies that sum to 2**BITS."""

    symbols: np.ndarray
    freq: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Counts scaled to the sum, each at least 1."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order].astype(np.int64), np.asarray(counts, np.float64)[order]
        total = 1 << BITS
        if len(symbols) > total // 2:
            raise ValueError("too many symbols for the table")
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (total - len(symbols)))).astype(np.int64)
        if len(freq):
            freq[np.argmax(freq)] += total - freq.sum()
        return cls(symbols, freq)

    def coder(self):
        start = np.concatenate([[0], np.cumsum(self.freq)])[:-1]
        size = int(self.symbols.max(initial=0)) + 1
        dense = np.zeros((2, size), np.uint64)
        dense[0, self.symbols], dense[1, self.symbols] = self.freq, start
        slot = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)
        return dense, slot, self.freq.astype(np.uint64), start.astype(np.uint64)


class Coder:
    def __init__(self, table: Table):
        self.table = table
        self.dense, self.slot, self.freq, self.start = table.coder()

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Each block of tokens as bytes; all blocks advance together."""
        if not blocks:
            return []
        n = np.array([len(b) for b in blocks])
        steps = -(-n // LANES)
        most = int(steps.max())
        grid = np.zeros((len(blocks), most * LANES), np.int64)
        for k, b in enumerate(blocks):
            grid[k, : len(b)] = b
        grid = grid.reshape(len(blocks), most, LANES)
        lane = np.arange(LANES)
        x = np.full((len(blocks), LANES), LOW)
        emitted, owner, checkpoints = [], [], {}
        ceiling = (LOW >> UB) << U32
        for t in range(most - 1, -1, -1):
            valid = t * LANES + lane[None, :] < n[:, None]
            f, c = self.dense[0][grid[:, t]], self.dense[1][grid[:, t]]
            if valid.all():
                full = x >= ceiling * f
            else:
                f = np.where(valid, f, np.uint64(1))
                full = valid & (x >= ceiling * f)
            if (f == 0).any():
                raise ValueError("a token is not in the table")
            emitted.append(x[full].astype(np.uint32))
            owner.append(np.nonzero(full)[0])
            x = np.where(full, x >> U32, x)
            q = x // f
            y = (q << UB) + (x - q * f) + c
            x = y if valid.all() else np.where(valid, y, x)
            if t % EVERY == 0:
                checkpoints[t // EVERY] = x.copy()
        sizes = [np.bincount(o, minlength=len(blocks)) for o in owner[::-1]]
        words, own = np.concatenate(emitted[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(len(blocks) + 1))
        upto = np.concatenate([np.zeros((1, len(blocks)), np.int64), np.cumsum(sizes, axis=0)])
        out = []
        for k, tokens in enumerate(blocks):
            marks = range(-(-int(steps[k]) // EVERY))
            at = np.array([upto[m * EVERY, k] for m in marks], np.uint32)
            states = np.concatenate([checkpoints[m][k] for m in marks]) if len(marks) else np.zeros(0, np.uint64)
            stream = words[order[edge[k] : edge[k + 1]]]
            body = at.tobytes() + states.tobytes() + stream.tobytes()
            head = np.array([MAGIC, len(tokens), len(marks), len(stream), zlib.crc32(body), zlib.crc32(tokens.astype("<u4").tobytes())], np.uint32)
            out.append(head.tobytes() + body)
        return out

    def decode(self, blobs: list[bytes], checkpoint: int = 0) -> list[np.ndarray]:
        """The tokens of each block, from a checkpoint on; checksums are verified."""
        if not blobs:
            return []
        heads = [np.frombuffer(b[:24], np.uint32).astype(np.int64) for b in blobs]
        n = np.array([h[1] for h in heads])
        skip = checkpoint * EVERY * LANES
        x = np.full((len(blobs), LANES), LOW)
        streams, at = [], np.zeros(len(blobs), np.int64)
        base = 0
        for k, (blob, h) in enumerate(zip(blobs, heads)):
            body = blob[24:]
            if h[0] != MAGIC or zlib.crc32(body) != h[4]:
                raise ValueError("damaged block")
            marks = int(h[2])
            stream = np.frombuffer(body, np.uint32, int(h[3]), 4 * marks + 8 * marks * LANES)
            if checkpoint < marks:
                x[k] = np.frombuffer(body, np.uint64, LANES, 4 * marks + 8 * LANES * checkpoint)
                at[k] = base + np.frombuffer(body, np.uint32, 1, 4 * checkpoint)[0]
            streams.append(stream)
            base += len(stream)
        words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        steps = -(-n // LANES)
        most = int(steps.max())
        first = checkpoint * EVERY
        got = np.zeros((len(blobs), max(most - first, 0), LANES), np.int32)
        lane = np.arange(LANES)
        for t in range(first, most):
            valid = t * LANES + lane[None, :] < n[:, None]
            low = x & MASK
            s = self.slot[low.astype(np.int64)]
            got[:, t - first] = s
            y = self.freq[s] * (x >> UB) + low - self.start[s]
            x = np.where(valid, y, x)
            need = valid & (x < LOW)
            rank = np.cumsum(need, axis=1)
            where = at[:, None] + rank - 1
            x = np.where(need, (x << U32) | words[np.where(need, where, len(words) - 1)], x)
            at += rank[:, -1]
        out = []
        for k, h in enumerate(heads):
            tokens = self.table.symbols[got[k].reshape(-1)[: max(0, int(n[k]) - skip)]]
            if not checkpoint and zlib.crc32(tokens.astype("<u4").tobytes()) != h[5]:
                raise ValueError("a block's tokens do not match their checksum")
            out.append(tokens)
        return out
