"""Subword lattices of many words at once, over a double-array trie of scored pieces.

A unit is a byte string that no piece crosses.  All units of a batch lie in one
flat array; the trie is walked from every character at once, and the recursions
run over end offsets, all units side by side.  A unit of more than LONG bytes runs by
itself, its edges built a block of BLOCK bytes at a time.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np

MARK = "▁".encode()
UNK = -2
LONG, BLOCK = 1 << 17, 1 << 16


@dataclass(frozen=True)
class Trie:
    """next = base[state] + byte, valid if check[next] == state + 1; value is the piece that ends there or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: dict[bytes, int]) -> Trie:
    """Double-array trie of the pieces."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for piece, number in pieces.items():
        node = 0
        for byte in piece:
            at = children[node].get(byte)
            if at is None:
                at = children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = at
        ends[node] = number
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [0] * size, [-1] * size
    slot = [0] * len(children)
    check[0] = -1
    free, queue = 1, [0]
    for node in queue:
        kids = sorted(children[node])
        state = slot[node]
        value[state] = ends[node]
        if not kids:
            continue
        at = max(free - kids[0], 1)
        while any(check[at + b] for b in kids):
            at += 1
            if at + 512 > size:
                base += [0] * size
                check += [0] * size
                value += [-1] * size
                size *= 2
        base[state] = at
        for b in kids:
            check[at + b] = state + 1
            slot[children[node][b]] = at + b
            queue.append(children[node][b])
        while free < size - 512 and check[free]:
            free += 1
        if len(kids) > 8 and len(queue) % 64 == 0:
            free = max(free, at - 256)
    pad = [0] * 512
    return Trie(np.array(base + pad, np.int32), np.array(check + pad, np.int32), np.array(value + pad * 1, np.int32))


def _unmarked(piece: bytes) -> bytes:
    """What follows a piece's leading markers."""
    while piece.startswith(MARK):
        piece = piece[len(MARK) :]
    return piece


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a log score each; scores are those of the file."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray  # 0 piece, 1 byte, 2 control or unused, 3 unknown
    trie: Trie
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    digest: str  # of pieces, scores and kinds

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i).encode() for i in range(n)]
        kinds = np.array([3 if model.is_unknown(i) else 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unused(i) else 0 for i in range(n)], np.int8)
        return cls.of(pieces, np.array([model.get_score(i) for i in range(n)], np.float64), kinds)

    @classmethod
    def of(cls, pieces: list[bytes], scores: np.ndarray, kinds: np.ndarray) -> Vocabulary:
        byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(kinds == 1):
            byte_ids[int(pieces[i][3:5], 16)] = i
        normal = np.flatnonzero(kinds == 0)
        trie = build_trie({pieces[i]: int(i) for i in normal})
        low = float(scores[normal].min()) if len(normal) else 0.0
        unknown = int(np.flatnonzero(kinds == 3)[0]) if (kinds == 3).any() else 0
        digest = hashlib.sha256(b"\0".join(pieces) + scores.tobytes() + kinds.tobytes()).hexdigest()
        return cls(pieces, scores, kinds, trie, byte_ids, unknown, low - 10.0, digest)

    def breaks(self) -> np.ndarray | None:
        """Bytes that are always pieces of their own; None if a marker can follow another character within a piece."""
        normal = [p for p, k in zip(self.pieces, self.kinds) if k == 0]
        if any(MARK in p[len(p) - len(_unmarked(p)) :] for p in normal):
            return None
        used = set(b"".join(normal))
        table = np.zeros(256, bool)
        table[[b for b in range(0x09, 0x0E) if b not in used]] = True
        return table

    def zipf(self, shift: float = 2.7, byte_mass: float = 1e-3) -> tuple[np.ndarray, float]:
        """(log probability of each piece, of an unknown byte): score -r is rank r, and rank r has weight 1 / (r + shift).

        Pieces whose score bars them from merging come last.
        """
        ranked = (self.kinds == 0) & (self.scores > -1e8)
        rank = np.where(ranked, 1.0 - np.minimum(self.scores, 0.0), 1.0 - min(self.scores[ranked].min(initial=0.0), 0.0) + 1.0)
        weight = np.where(self.kinds == 0, 1.0 / (rank + shift), 0.0)
        with np.errstate(divide="ignore"):
            return np.log(weight / weight.sum() * (1 - byte_mass)), float(np.log(byte_mass / 256))


@dataclass(frozen=True)
class Edges:
    """Sorted by end offset within the unit, end, start."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    level: np.ndarray  # first edge of each end offset, and the number of edges
    first: np.ndarray  # starts its unit


def edges(trie: Trie, data: np.ndarray, offs: np.ndarray) -> Edges:
    """Every piece that occurs in a unit, and an unknown edge where no piece is a single character."""
    n = len(data)
    lengths = np.diff(offs)
    unit_start, unit_end = np.repeat(offs[:-1], lengths), np.repeat(offs[1:], lengths)
    opens = (data & 0xC0) != 0x80
    opens[offs[:-1][lengths > 0]] = True
    chars = np.flatnonzero(opens)
    char_end = np.append(chars[1:], n)
    pos, state, cur = chars, np.zeros(len(chars), np.int32), chars
    found = []
    while len(pos):
        nxt = trie.base[state] + data[cur]
        ok = trie.check[nxt] == state + 1
        pos, state, cur = pos[ok], nxt[ok], cur[ok] + 1
        hit = trie.value[state] >= 0
        found.append((pos[hit], cur[hit], trie.value[state[hit]]))
        live = cur < unit_end[pos]
        pos, state, cur = pos[live], state[live], cur[live]
    start, end, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    to = np.zeros(n + 1, np.int64)
    to[chars] = char_end
    single = np.zeros(n + 1, bool)
    single[start[to[start] == end]] = True
    lone = ~single[chars]
    start = np.concatenate([start, chars[lone]])
    end = np.concatenate([end, char_end[lone]])
    piece = np.concatenate([piece, np.full(lone.sum(), UNK)])
    rel = end - unit_start[start]
    span = int((end - start).max(initial=0)) + 1
    order = np.argsort((rel * (n + 1) + end) * span + (span - 1 - (end - start)))
    start, end, piece, rel = start[order], end[order], piece[order], rel[order]
    level = np.append(np.flatnonzero(np.diff(rel, prepend=-1)), len(rel))
    return Edges(start, end, piece, level, start == unit_start[start] if len(start) else np.zeros(0, bool))


def _levels(e: Edges):
    """(first edge, last edge + 1, group starts from 0) of each end offset."""
    new = np.ones(len(e.end), bool)
    new[1:] = e.end[1:] != e.end[:-1]
    for i, j in zip(e.level[:-1], e.level[1:]):
        new_group = new[i:j].copy()
        new_group[0] = True
        yield i, j, np.flatnonzero(new_group)


def _by_end(vocabulary: Vocabulary, unit: np.ndarray):
    """Of one unit, for each end offset in ascending order: (end, starts, pieces) of its edges, longest first."""
    longest = max(map(len, vocabulary.pieces), default=1)
    done = 0
    while done < len(unit):
        stop = min(done + BLOCK, len(unit))
        while stop < len(unit) and unit[stop] & 0xC0 == 0x80:
            stop += 1
        low = max(0, done - longest)
        while low and unit[low] & 0xC0 == 0x80:
            low -= 1
        e = edges(vocabulary.trie, unit[low:stop], np.array([0, stop - low]))
        for i, j in zip(e.level[:-1].tolist(), e.level[1:].tolist()):
            if e.end[i] + low > done:
                yield int(e.end[i]) + low, (e.start[i:j] + low).tolist(), e.piece[i:j].tolist()
        done = stop


def _long_path(vocabulary: Vocabulary, unit: np.ndarray) -> np.ndarray:
    """best_path of one long unit, before fallback: (piece, start, end) rows."""
    n = len(unit)
    best, back, piece = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int32)
    for end, starts, pieces in _by_end(vocabulary, unit):
        best[end] = -math.inf
        for a, p in zip(starts, pieces):
            score = best[a] + (vocabulary.unknown_score if p == UNK else vocabulary.scores[p])
            if score > best[end]:
                best[end], back[end], piece[end] = score, a, p
    steps, at = [], n
    while at:
        steps.append((piece[at], back[at], at))
        at = back[at]
    return np.array(steps[::-1], np.int64).reshape(-1, 3)


def _long_marginal(vocabulary: Vocabulary, logp: np.ndarray, log_byte: float, unit: np.ndarray) -> float:
    """log_marginal of one long unit."""
    alpha = np.zeros(len(unit) + 1)
    for end, starts, pieces in _by_end(vocabulary, unit):
        terms = [alpha[a] + (log_byte * (end - a) if p == UNK else logp[p]) for a, p in zip(starts, pieces)]
        top = max(terms)
        alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms)) if math.isfinite(top) else top
    return float(alpha[-1])


def in_steps(sizes: np.ndarray, most: int = 1 << 16):
    """(first, last + 1) of runs of units of about ``most`` bytes; one of more than LONG is a run of its own."""
    upto = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = upto[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, base + most, "right")))
        yield lo, hi
        lo = hi


def best_path(vocabulary: Vocabulary, data: np.ndarray, offs: np.ndarray):
    """(ids, offsets): the best scored segmentation of each unit; of equal ones, that with the longest last piece.

    A character that no piece covers becomes its byte pieces, or the unknown id if there are none.
    """
    out, sizes = [], []
    for lo, hi in in_steps(np.diff(offs)):
        ids, edge = _paths(vocabulary, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        out.append(ids)
        sizes.append(np.diff(edge))
    return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])


def _paths(vocabulary: Vocabulary, data: np.ndarray, offs: np.ndarray):
    if len(offs) == 2 and len(data) > LONG:
        ids, start, end = _long_path(vocabulary, data).T
        return _with_bytes(vocabulary, data, np.zeros(len(ids), np.int64), ids.astype(np.int32), start, end, 1)
    e = edges(vocabulary.trie, data, offs)
    score = np.where(e.piece == UNK, vocabulary.unknown_score, vocabulary.scores[np.maximum(e.piece, 0)])
    best, back = np.zeros(len(data) + 1), np.zeros(len(data) + 1, np.int64)
    for i, j, group in _levels(e):
        cand = np.where(e.first[i:j], 0.0, best[e.start[i:j]]) + score[i:j]
        top = np.maximum.reduceat(cand, group)
        which = np.repeat(np.arange(len(group)), np.diff(np.append(group, j - i)))
        hit = np.flatnonzero(cand == top[which])
        hit = hit[np.diff(which[hit], prepend=-1) > 0]
        best[e.end[i:j][group]] = top
        back[e.end[i:j][group]] = hit + i
    unit = np.flatnonzero(np.diff(offs))
    at, floor = offs[unit + 1], offs[unit]
    steps = []
    while len(unit):
        k = back[at]
        steps.append((unit, k))
        at = e.start[k]
        more = at > floor
        unit, at, floor = unit[more], at[more], floor[more]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    unit, k = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(unit * (len(data) + 1) + e.start[k])
    unit, k = unit[order], k[order]
    return _with_bytes(vocabulary, data, unit, e.piece[k].astype(np.int32), e.start[k], e.end[k], len(offs) - 1)


def _with_bytes(vocabulary: Vocabulary, data, unit, ids, start, end, n_units: int):
    """(ids, offsets) of the units' pieces, characters that no piece covers as bytes or the unknown id."""
    width = np.ones(len(ids), np.int64)
    if (ids == UNK).any():
        if (vocabulary.byte_ids >= 0).all():
            width = np.where(ids == UNK, end - start, 1)
            at = np.cumsum(width) - width
            inner = np.arange(width.sum()) - np.repeat(at, width)
            was = np.repeat(ids, width)
            ids = np.where(was == UNK, vocabulary.byte_ids[data[np.repeat(start, width) + inner]], was).astype(np.int32)
        else:
            ids = np.where(ids == UNK, vocabulary.unknown, ids).astype(np.int32)
    total = np.bincount(unit, weights=width, minlength=n_units).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(total)])


def _forward(e: Edges, score: np.ndarray, n: int) -> np.ndarray:
    """Log of the summed probability of all paths to each offset."""
    alpha = np.zeros(n + 1)
    for i, j, group in _levels(e):
        cand = np.where(e.first[i:j], 0.0, alpha[e.start[i:j]]) + score[i:j]
        top = np.maximum.reduceat(cand, group)
        floor = np.where(np.isfinite(top), top, 0.0)
        size = np.diff(np.append(group, j - i))
        with np.errstate(divide="ignore"):
            alpha[e.end[i:j][group]] = floor + np.log(np.add.reduceat(np.exp(cand - np.repeat(floor, size)), group))
    return alpha


def log_marginal(vocabulary: Vocabulary, logp: np.ndarray, log_byte: float, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each unit, by forward recursion."""
    out = np.zeros(len(offs) - 1)
    for lo, hi in in_steps(np.diff(offs)):
        part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if hi - lo == 1 and len(part) > LONG:
            out[lo] = _long_marginal(vocabulary, logp, log_byte, part)
            continue
        e = edges(vocabulary.trie, part, at)
        alpha = _forward(e, np.where(e.piece == UNK, log_byte * (e.end - e.start), logp[np.maximum(e.piece, 0)]), len(part))
        out[lo:hi] = np.where(np.diff(at) > 0, alpha[at[1:]], 0.0)
    return out


def expected_pieces(vocabulary: Vocabulary, logp: np.ndarray, log_byte: float, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often each piece is expected over all segmentations of all units, and last the bytes no piece covers.

    Units of more than LONG bytes count by the pieces of their blocks of that size.
    """
    total = np.zeros(len(vocabulary.pieces) + 1)
    sizes = np.diff(offs)
    if (sizes > LONG).any():
        cut = [np.arange(a, b, LONG) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        offs = np.append(np.concatenate(cut), offs[-1])
    for lo, hi in in_steps(np.diff(offs)):
        total += _expected(vocabulary, logp, log_byte, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
    return total


def _expected(vocabulary: Vocabulary, logp, log_byte, data, offs) -> np.ndarray:
    e = edges(vocabulary.trie, data, offs)
    score = np.where(e.piece == UNK, log_byte * (e.end - e.start), logp[np.maximum(e.piece, 0)])
    alpha = _forward(e, score, len(data))
    beta = np.full(len(data) + 1, -np.inf)
    beta[offs[1:]] = 0.0
    for i, j in zip(e.level[-2::-1], e.level[:0:-1]):  # edges of one level all start at different offsets
        inner = np.flatnonzero(~e.first[i:j]) + i
        beta[e.start[inner]] = np.logaddexp(beta[e.start[inner]], score[inner] + beta[e.end[inner]])
    whole = np.repeat(alpha[offs[1:]], np.diff(offs))
    posterior = np.exp(np.where(e.first, 0.0, alpha[e.start]) + score + beta[e.end] - whole[e.start])
    known = e.piece != UNK
    out = np.bincount(e.piece[known], weights=posterior[known], minlength=len(vocabulary.pieces))
    return np.append(out, (posterior * (e.end - e.start))[~known].sum())
