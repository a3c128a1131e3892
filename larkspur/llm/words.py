"""Whole-batch tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All the work is
done on the UTF-8 bytes of a slice of rows at once; a slice holds about
``max_bytes`` of text (a longer document is a slice of its own), so memory does
not depend on the size of an Arrow batch.

Words that are looked up are told apart by their bytes (distinct_words, RaggedCache).
Where only hashes travel, they are taken under the secret Keys of a run: words by
mixed 8-byte pieces, runs of words by a Rabin-Karp polynomial modulo 2**61 - 1.  So
no text can be written to collide; n hashes agree by chance in about n * n / 2**62 pairs.
"""

from __future__ import annotations

import itertools
import random
import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PRIME = (1 << 61) - 1
P, P_BITS = np.uint64(PRIME), np.uint64(61)
LOW32, U29, U32, U3 = np.uint64(0xFFFFFFFF), np.uint64(29), np.uint64(32), np.uint64(3)
LOW29 = np.uint64((1 << 29) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

_POWERS: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Keys:
    """Secret numbers of one run, drawn on the driver; all its tasks hash with them."""

    word: int
    base: int
    last: int

    @classmethod
    def new(cls, seed: int | None = None) -> Keys:
        rng = secrets.SystemRandom() if seed is None else random.Random(seed)
        return cls(rng.getrandbits(64), rng.randrange(1 << 32, PRIME - 1), rng.getrandbits(64))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & P) + (x >> P_BITS)
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    b = np.asarray(b, np.uint64)
    a1, a0, b1, b0 = a >> U32, a & LOW32, b >> U32, b & LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    total = ((a1 * b1) << U3) + (middle >> U29) + ((middle & LOW29) << U32) + (low & P) + (low >> P_BITS)
    return _reduced(total)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, times(have[: size - len(have)], pow(base, len(have), PRIME))])
        if size <= 2 * SLICE_BYTES:
            if len(_POWERS) > 8:
                _POWERS.clear()
            _POWERS[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of value * base**position modulo PRIME, one longer than values."""
    terms = times(_reduced(values), powers(base, len(values)))
    high, low = np.cumsum(terms >> U32, dtype=np.uint64), np.cumsum(terms & LOW32, dtype=np.uint64)
    out = np.zeros(len(values) + 1, np.uint64)
    out[1:] = _reduced((high >> U29) + ((high & LOW29) << U32) + low)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: Keys) -> np.ndarray:
    """Hash of values[start:end] for each span of the values that were summed with keys.base."""
    raw = _reduced(sums[ends] + (P - sums[starts]))
    raw = times(raw, powers(pow(keys.base, -1, PRIME), len(sums))[starts])
    return mix(raw + (ends - starts).astype(np.uint64) * STEP ^ np.uint64(keys.last))


def text_parts(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets from 0) slices of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR):
    """(starts, ends, first word of each document and the total) of the words in a slice."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    sep = separator[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = sep[:-1]
    edge[offs] = True
    starts = np.flatnonzero(~sep & edge[:n])
    edge[1:n] = sep[1:]
    edge[n] = edge[0] = True
    edge[offs] = True
    ends = np.flatnonzero(~sep & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: Keys) -> np.ndarray:
    """A 64-bit hash of each word; different words of up to 7 bytes always differ."""
    padded = np.append(data, np.zeros(8, np.uint8))
    loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    key = mix(np.array([keys.word], np.uint64))[0]
    short = np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)
    out = mix((loads[starts] & MASKS[np.minimum(size, 8)] | short) ^ key)
    long = np.flatnonzero(size > 7)
    if len(long):
        sums = size[long].astype(np.uint64) * STEP + mix(key[None] + STEP)
        more = (size[long] - 1) >> 3  # further pieces of 8 bytes
        has = np.flatnonzero(more)
        if len(has):
            more = more[has]
            upto = np.cumsum(more)
            number = np.arange(upto[-1]) - np.repeat(upto - more, more) + 1
            where = np.repeat(starts[long[has]], more) + 8 * number
            left = np.minimum(np.repeat(ends[long[has]], more) - where, 8)
            piece = loads[where] & MASKS[left]
            terms = mix(piece ^ mix(number.astype(np.uint64) * STEP + key))
            sums[has] += np.add.reduceat(terms, upto - more)
        out[long] = mix(out[long] + sums)
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int, keys: Keys):
    """(first word, document row, hash) of each run of width words within one document."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.repeat(first[1:], counts) - np.arange(len(row)) >= width)
    return at, row[at], span_hash(prefix_sums(hashes, keys.base), at, at + width, keys)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Concatenate data[start:start+length]; returns it with its offsets."""
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    at = np.repeat(starts - offs[:-1], lengths)
    at += np.arange(offs[-1])
    return data[at], offs


def strings(data: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """An Arrow string (or other) array over bytes and offsets."""
    out = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(kind or pa.string())


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None):
    """(number of each word, a word with each number): words have one number if their bytes are equal.

    Without ``ends`` a word goes up to the next one.  With them words are compared first with
    the separators behind them, so that nothing is copied, and then the distinct ones without.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = strings(data, np.append(starts, len(data)), pa.large_binary()).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    sample = np.empty(len(coded.dictionary), np.int64)
    sample[code[::-1]] = np.arange(len(code))[::-1]
    if ends is not None:
        body, offs = gather(data, starts[sample], ends[sample] - starts[sample])
        again, some = distinct_words(body, offs[:-1])
        code, sample = again[code], sample[some]
    return code, sample


_KEPT: dict = {}


def of_worker(name, make):
    """What make() gives, kept for the worker's next tasks under that name; a worker keeps one such thing at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops what of_worker keeps; operators that keep nothing call it before they use memory of their own."""
    _KEPT.clear()


class RaggedCache:
    """Byte string -> list of ids, for as many strings as ``most`` and some 64 MB of them; it starts anew beyond that.

    ``make(data, offs)`` gives (flat ids, offsets) for strings it has not met.
    """

    MOST_BYTES = 64 << 20

    def __init__(self, make, most: int = 300_000):
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offs = np.zeros(1 << 14, np.int64)
        self.used = self.bytes = 0

    def lookup(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in self.flat for each string of a slice."""
        keys = strings(data, edge, pa.large_binary()).to_pylist()
        if self.index and (len(self.index) + len(keys) > self.most or self.bytes + len(data) > self.MOST_BYTES):
            self.clear()
        at = np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            n = len(self.index)
            unmet = [keys[k] for k in new.tolist()]
            fresh = list(dict.fromkeys(unmet))
            self.index.update(zip(fresh, range(n, n + len(fresh))))
            at[new] = np.fromiter(map(self.index.__getitem__, unmet), np.int64, len(unmet))
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))])
            body = np.frombuffer(b"".join(fresh), np.uint8)
            self.bytes += len(body)
            flat, offs = self.make(body, offs)
            while len(self.flat) < self.used + len(flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.offs) < n + len(fresh) + 1:
                self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.offs[n : n + len(fresh) + 1] = offs + self.used
            self.used += len(flat)
        return self.offs[at], self.offs[at + 1] - self.offs[at]
