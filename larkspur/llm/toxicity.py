"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nystrom landmarks.

The kernel k of two words sums, over all subsequences of 3 letters they share that
span at most ``reach`` letters, DECAY to the power of the spans in both; it is normalised
to 1 for equal words.  So letters put between those of a word, or left out, only weaken
the match.  Words are in lower case, letters only, look-alike digits and signs read as
letters, and runs of single characters joined ("i d i o t").  The kernel of two sentences
sums k ** POWER over all pairs of their words; words that many clean training texts hold
count as none.  A sentence ends behind a word that ends in one of . ! ? or stands
last in its line; one of more than LONGEST words counts as several.

Landmarks are sentences of labelled training texts, some hundred.  The Nystrom map (the
inverse root of the landmarks' kernel matrix) and a linear SVM (squared hinge loss)
follow.  A text is as toxic as its most toxic sentence (multiple-instance learning: each
round picks that of every training text, anew for toxic ones, in addition for clean
ones).  The threshold has the fewest errors (a clean text above it counts twice) on texts that
the fit has not seen, in four folds, and a logistic slope turns margins into scores.  As a sentence's margin is a sum
over its words, a word's share is worked out once.

Labels come from a bounded sample of labelled rows (``sample``, by hash of the id), whose
texts stay on the executors; the driver gets a vector for each of their sentences that was
picked.  Every text is scored whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import cluster, words

DECAY = 0.8
POWER = 4
REACH = 9  # letters from a subsequence's first to its last, at most
LONGEST = 40  # words of a sentence, and letters of a landmark's words
LETTERS = np.full(256, 255, np.uint8)
LETTERS[97:123] = np.arange(26)
LETTERS[65:91] = np.arange(26)
for _sign, _letter in zip(b"013457@$!", b"oleastasi"):
    LETTERS[_sign] = _letter - 97
N_FEATURES = 26**3
STOPS = 20_000  # words that count as none, at most: the most frequent ones
SLICE_BYTES = 1 << 20


def letters_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(letters, offsets) of words; other characters are left out."""
    body, edge = words.gather(LETTERS[data], starts, ends - starts)
    keep = body != 255
    return body[keep], np.concatenate([[0], np.cumsum(keep)])[edge]


def _triples(length: int, reach: int):
    """(i, j, k, weight) of the subsequences of a word of that length."""
    rows = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + reach)) for j in range(i + 1, k)]
    at = np.array(rows, np.int64).reshape(-1, 3).T
    return at[0], at[1], at[2], DECAY ** (at[2] - at[0] + 1.0)


def features(body: np.ndarray, offs: np.ndarray, reach: int = REACH, most: int = 1 << 20):
    """Yield (words, features, weights, norms), all words of a length together; a row of features for each word.

    Feature and weight arrays have at most about ``most`` entries; a longer word's features
    are summed and come by themselves, without zeros.
    """
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 3) :]
    edge = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:]):
        length = int(size[order[a]])
        if length > 4 * LONGEST:
            for w in order[a:b]:
                feature, weight = _long_features(body[offs[w] : offs[w + 1]], reach)
                yield np.array([w]), feature[None, :], weight[None, :], np.sqrt([(weight * weight).sum()])
            continue
        i, j, k, weight = _triples(length, reach)
        step = max(1, most // len(i))
        for lo in range(a, b, step):
            some = order[lo : min(lo + step, b)]
            letter = body[offs[some][:, None] + np.arange(length)].astype(np.int32)
            feature = letter[:, i] * 676 + letter[:, j] * 26 + letter[:, k]
            turn = np.argsort(feature, axis=1)
            flat = np.take_along_axis(feature, turn, 1).reshape(-1)
            new = np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            new[:: len(i)] = True
            first = np.flatnonzero(new)
            total = np.add.reduceat(weight[turn].reshape(-1), first)
            norm = np.sqrt(np.add.reduceat(total * total, np.searchsorted(first, np.arange(len(some)) * len(i))))
            yield some, feature, np.broadcast_to(weight, feature.shape), norm


def _long_features(letter: np.ndarray, reach: int):
    """(features, weights) of one long word, a block of places at a time."""
    total = np.zeros(N_FEATURES)
    n = len(letter)
    for lo in range(0, n, 1 << 14):
        part = letter[lo : min(lo + (1 << 14) + reach, n)].astype(np.int64)
        own = min(1 << 14, n - lo)
        for c in range(2, reach):
            i = np.arange(max(0, min(own, len(part) - c)))
            for b in range(1, c):
                total += DECAY ** (c + 1) * np.bincount(part[i] * 676 + part[i + b] * 26 + part[i + c], minlength=N_FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Vocabulary:
    """Words of letters 0 to 25, their normalised features by feature."""

    names: list[bytes]
    reach: int
    edge: np.ndarray  # of each feature's entries
    owner: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, names: list[bytes], reach: int = REACH) -> Vocabulary:
        offs = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
        owner, feature, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for some, f, w, norm in features(np.frombuffer(b"".join(names), np.uint8), offs, reach):
            owner.append(np.repeat(some, f.shape[1]))
            feature.append(f.reshape(-1).astype(np.int64))
            weight.append((w / norm[:, None]).reshape(-1))
        owner, feature, weight = np.concatenate(owner), np.concatenate(feature), np.concatenate(weight)
        key, at = np.unique(feature * max(len(names), 1) + owner, return_inverse=True)
        weight = np.bincount(at, weights=weight, minlength=len(key)).astype(np.float64)
        feature, owner = np.divmod(key, max(len(names), 1))
        return cls(names, reach, np.searchsorted(feature, np.arange(N_FEATURES + 1)), owner, weight)

    def kernel(self, body: np.ndarray, offs: np.ndarray, most: int = 1 << 19):
        """Yield (words, k ** POWER of them and the vocabulary's words) in blocks; words without features have none."""
        m = len(self.names)
        size = self.edge[1:] - self.edge[:-1]
        for some, f, w, norm in features(body, offs, self.reach):
            step = max(1, most // max(m, 1))
            for lo in range(0, len(some), step):
                feature = f[lo : lo + step].reshape(-1)
                row = np.repeat(np.arange(len(some[lo : lo + step])), f.shape[1])
                n = size[feature]
                used = np.flatnonzero(n)
                feature, row, n = feature[used], row[used], n[used]
                upto = np.cumsum(n)
                at = np.repeat(self.edge[feature] - upto + n, n)
                at += np.arange(len(at))
                value = self.weight[at]
                value *= np.repeat(w[lo : lo + step].reshape(-1)[used], n)
                cell = np.repeat(row * m, n)
                cell += self.owner[at]
                dense = np.bincount(cell, weights=value, minlength=len(some[lo : lo + step]) * m).reshape(len(some[lo : lo + step]), m)
                dense = dense / norm[lo : lo + step, None]
                dense *= dense
                yield some[lo : lo + step], dense * dense


def _joined(data, starts, ends, line, first):
    """(letters, offsets, place) of runs of three or more single characters in a line, as words; place: their last."""
    single = np.flatnonzero(ends - starts == 1)
    if len(single) < 3:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(single), bool)
    new[1:] = (np.diff(single) != 1) | line[single[:-1]]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(single)))
    keep = size >= 3
    take = np.repeat(keep, size)
    edge = np.concatenate([[0], np.cumsum(size[keep])])
    body, offs = letters_of(data[starts[single[take]]], edge[:-1], edge[1:])
    return body, offs, single[np.append(at[1:], len(single))[keep] - 1]


class Sentences:
    """A slice's words by sentence: distinct words as letters, and for each word its sentence and its number."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, first = words.word_spans(data, offs)
        n = len(starts)
        lines = np.flatnonzero(data == 10)
        line = np.zeros(n, bool)  # last word of its line or text
        line[np.searchsorted(starts, lines)[np.searchsorted(starts, lines) > 0] - 1] = True
        line[first[1:][first[1:] > first[:-1]] - 1] = True
        close = line | np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if n else line
        begin = np.flatnonzero(np.append(True, close[:-1])) if n else np.zeros(0, np.int64)
        run = np.repeat(begin, np.diff(np.append(begin, n)))
        within = np.arange(n) - run
        close = close | (within % LONGEST == LONGEST - 1)
        code, sample = words.distinct_words(data, starts, ends)
        letters, edge = letters_of(data, starts[sample], ends[sample])
        more, more_edge, place = _joined(data, starts, ends, line, first)
        self.letters, self.offs = np.concatenate([letters, more]), np.concatenate([edge, edge[-1] + more_edge[1:]])
        sentence = np.cumsum(close) - close
        token = np.concatenate([code, len(sample) + np.arange(len(place))])
        where = np.concatenate([sentence, sentence[place]])
        order = np.argsort(where, kind="stable") if len(place) else slice(None)
        self.token, self.sentence = token[order], where[order]
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        self.doc = doc[close]  # of each sentence

    def sums(self, share: np.ndarray) -> np.ndarray:
        """The sum of the words' shares of each sentence."""
        return np.bincount(self.sentence, weights=share[self.token], minlength=len(self.doc))


class Shares:
    """Each word's share of a margin, kept for words that were met."""

    MOST = 800_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, letters: np.ndarray, offs: np.ndarray) -> np.ndarray:
        keys = words.strings(letters, offs, pa.large_binary()).to_pylist()
        if len(self.known) + len(keys) > self.MOST:
            self.known = {}
        share = np.fromiter(map(self.known.get, keys, itertools.repeat(np.nan)), np.float64, len(keys))
        new = np.flatnonzero(np.isnan(share))
        if len(new):
            fresh = list(dict.fromkeys(keys[k] for k in new.tolist()))
            some = [k for k in fresh if len(k) > 2 and k not in self.model.stops]
            self.known.update(zip(fresh, itertools.repeat(0.0)))
            body, edge = np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))])
            for which, k in self.model.vocabulary.kernel(body, edge):
                self.known.update(zip(map(some.__getitem__, which.tolist()), (k @ self.model.weights).tolist()))
            share[new] = np.fromiter((self.known[keys[k]] for k in new.tolist()), np.float64, len(new))
        return share


@dataclass(frozen=True)
class Model:
    """A word's share is the kernel with the vocabulary times weights; a text's margin is the largest sum of a sentence, plus bias."""

    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    stops: frozenset = frozenset()
    digest: str = field(default="", compare=False)

    def __post_init__(self):
        made = hashlib.sha256(b"\0".join([*self.vocabulary.names, *sorted(self.stops)]) + np.asarray(self.weights).tobytes() + repr((self.bias, self.vocabulary.reach)).encode())
        object.__setattr__(self, "digest", made.hexdigest())

    def shares(self) -> Shares:
        return words.of_worker(("shares", self.digest), lambda: Shares(self))

    def margin(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        s = Sentences(data, offs)
        out = np.full(len(offs) - 1, -np.inf)
        np.maximum.at(out, s.doc, s.sums(self.shares().of(s.letters, s.offs)))
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """0 to 1 for each text of a slice; a text without words has an empty sum."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(data, offs) + self.shift, -500, 500)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 60, block: int = 1024):
    """Weights and bias of a squared-hinge SVM, by Newton steps; classes weigh the same in total.

    Rows are taken a block at a time, so that no copy of x is made.
    """
    n, m = x.shape
    sign = np.where(y > 0, 1.0, -1.0)
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * cost * 100
    w = np.zeros(m + 1)
    ridge = np.ones(m + 1)
    ridge[-1] = 1e-6

    def blocks():
        for lo in range(0, n, block):
            part = np.ones((min(block, n - lo), m + 1))
            part[:, :-1] = x[lo : lo + block]
            yield slice(lo, lo + block), part

    def slack_of(v):
        return np.maximum(0, 1 - sign * np.concatenate([part @ v for _, part in blocks()]))

    def loss(v, slack):
        return 0.5 * (ridge * v * v).sum() + 0.5 * (weigh * slack * slack).sum()

    slack = slack_of(w)
    for _ in range(steps):
        gradient, hessian = ridge * w, np.diag(ridge)
        for at, part in blocks():
            gradient -= (weigh[at] * sign[at] * slack[at]) @ part
            some = part[slack[at] > 0]
            hessian += (some * weigh[at][slack[at] > 0, None]).T @ some
        step = np.linalg.solve(hessian, gradient)
        if np.abs(step).max() < 1e-8:
            break
        size, now = 1.0, loss(w, slack)
        slack = slack_of(w - step)
        while size > 1e-4 and loss(w - size * step, slack) > now:
            size /= 2
            slack = slack_of(w - size * step)
        w = w - size * step
    return w[:-1], w[-1]


def fit_slope(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> float:
    """The slope of a logistic curve through 0.5 at margin 0."""
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    slope = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        step = (margin * (p - goal)).sum() / ((margin**2 * p * (1 - p)).sum() + 1e-4)
        slope -= step * min(1.0, 2.0 / max(abs(step), 1e-9))
    return max(slope, 1e-2)


def best_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds with the fewest errors; a clean text above counts as two."""
    order = np.argsort(-margin, kind="stable")
    hit = y[order] > 0
    errors = np.concatenate([[0], 2 * np.cumsum(~hit)]) + hit.sum() - np.concatenate([[0], np.cumsum(hit)])
    edges = np.concatenate([[margin.max() + 1e-6], margin[order]])
    cut = np.append(edges[1:] < edges[:-1], True)  # equal margins fall on one side
    best = np.flatnonzero((errors == errors[cut].min()) & cut)
    k = int(best[len(best) // 2])
    return float((edges[k] + edges[k + 1]) / 2) if k + 1 < len(edges) else float(edges[k]) - 1e-6


def _slices(batch, column: int):
    for lo, hi, data, offs in words.text_parts(batch.column(column), SLICE_BYTES):
        yield lo, hi, data, offs


def _word_documents(batches):
    """(word, toxic, n): in how many texts of either label a word of 3 letters or more occurs."""
    for batch in batches:
        for lo, hi, data, offs in _slices(batch, 1):
            s = Sentences(data, offs)
            coded = words.strings(s.letters, s.offs, pa.large_binary()).dictionary_encode()
            number = coded.indices.to_numpy().astype(np.int64)[s.token]
            pair = np.unique(s.doc[s.sentence] * max(len(coded.dictionary), 1) + number)
            toxic = batch.column(0).to_numpy()[lo:hi][pair // max(len(coded.dictionary), 1)]
            key, n = np.unique(pair % max(len(coded.dictionary), 1) * 2 + toxic, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // 2)).cast(pa.binary()), pa.array(key % 2, pa.int32()), pa.array(n, pa.int64())], ["word", "toxic", "n"])


def _sentences(data, offs, stops):
    """(text, words) of each sentence, words that count only."""
    s = Sentences(data, offs)
    names = words.strings(s.letters, s.offs, pa.large_binary()).to_pylist()
    edge = np.searchsorted(s.sentence, np.arange(len(s.doc) + 1))
    for k, d in enumerate(s.doc.tolist()):
        some = [names[t] for t in s.token[edge[k] : edge[k + 1]].tolist()]
        yield d, [w for w in some if len(w) > 2 and w not in stops]


def _landmarks(stops: frozenset, telling: dict):
    """(toxic, word, n, h, sentence): sentences of n words of toxic texts with a telling word, and one of each clean text."""

    def run(batches):
        for batch in batches:
            rows, clean = [], {}
            for lo, hi, data, offs in _slices(batch, 1):
                toxic = batch.column(0).to_numpy()[lo:hi]
                for d, some in _sentences(data, offs, stops):
                    if not some or len(max(some, key=len)) > LONGEST:
                        continue
                    sentence = b"\xff".join(some)
                    h = zlib.crc32(sentence)
                    if toxic[d]:
                        best = min((telling[w] for w in some if w in telling), default=None)
                        if best is not None:
                            rows.append((1, best, len(some), h, sentence))
                    elif (lo + d) not in clean or clean[lo + d][3] > h:
                        clean[lo + d] = (0, 0, len(some), h, sentence)
            rows += clean.values()
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["toxic", "word", "n", "h", "sentence"])

    return run


def _picked(shared, coordinates):
    """Of each text, its sentence of the largest margin as kernel values with the landmarks."""

    def run(batches):
        model, a = shared.value, coordinates.value
        for batch in batches:
            for lo, hi, data, offs in _slices(batch, 3):
                s = Sentences(data, offs)
                total = s.sums(model.shares().of(s.letters, s.offs))
                order = np.lexsort((-total, s.doc))
                best = order[np.flatnonzero(np.diff(s.doc[order], prepend=-1))]
                edge = np.searchsorted(s.sentence, [best, best + 1])
                n = edge[1] - edge[0]
                token = s.token[np.repeat(edge[0] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                used, back = np.unique(token, return_inverse=True)
                body, offs_ = words.gather(s.letters, s.offs[used], s.offs[used + 1] - s.offs[used])
                names = words.strings(body, offs_, pa.large_binary()).to_pylist()
                counts = np.array([len(w) > 2 and w not in model.stops for w in names], bool)
                rows = np.zeros((len(used), a.shape[1]))
                for which, k in model.vocabulary.kernel(body, offs_):
                    rows[which] = k @ a
                rows[~counts] = 0
                out = np.zeros((hi - lo, a.shape[1]), np.float32)
                np.add.at(out, s.doc[best][np.repeat(np.arange(len(best)), n)], rows[back])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "uid", "y", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000, toxic_landmarks: int = 256, clean_landmarks: int = 64, rounds: int = 3, reach: int = REACH, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled training rows, the lowest by hash of their id.

    Training rows have crc32(id) mod 5 other than 0, an id and a label of 0 or 1 (1 if both
    are given).  Without both classes the model gives every text the share of label 1 (0
    without rows).
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(cluster.crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).drop("h")
    folder = cluster.shared_folder(spark)
    texts = cluster.with_uid(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    texts = cluster.written(texts.join(F.broadcast(rows), "doc_id").select("doc_id", "uid", "y", "text"), folder, "labelled")
    n1, n0 = texts.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n1 or not n0:
        p = (n1 + 1e-6) / (n1 + n0 + 1e-6) if n1 else 0.0
        return Model(Vocabulary.of([], reach), np.zeros(0), 0.0, 1.0, math.log((p + 1e-6) / (1 - p + 1e-6)))

    counted = texts.select("y", "text").mapInArrow(_word_documents, "word binary, toxic int, n long")
    counted = counted.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")).where(F.length("word") > 2)
    counted = cluster.written(counted, folder, "words")
    often = counted.where(F.col("c") > 0.02 * n0).orderBy(F.desc("c"), "word").limit(STOPS)
    stops = frozenset(bytes(r.word) for r in often.select("word").collect())
    rare = counted.where((F.col("c") <= 0.02 * n0) & (F.col("t") > 1) & (F.col("t") * n0 > F.col("c") * n1))
    cell = lambda seen, of: F.when(seen > 0, seen * F.log(seen / ((F.col("t") + F.col("c")) * of / (n1 + n0)))).otherwise(0.0)
    gone = lambda seen, of: F.when(of - seen > 0, (of - seen) * F.log((of - seen) / ((n1 + n0 - F.col("t") - F.col("c")) * of / (n1 + n0)))).otherwise(0.0)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    g2 = 2 * (cell(t, F.lit(float(n1))) + cell(c, F.lit(float(n0))) + gone(t, F.lit(float(n1))) + gone(c, F.lit(float(n0))))
    top = rare.withColumn("g2", F.round(g2, 6)).orderBy(F.desc("g2"), "word").limit(64).collect()
    chance = 2 * math.log(counted.count() + 1)  # the largest value to expect of so many words by chance
    best = [bytes(r.word) for r in top if r.g2 > chance] or [bytes(r.word) for r in top[:8]]

    found = cluster.written(texts.select("y", "text").mapInArrow(_landmarks(stops, {w: k for k, w in enumerate(best)}), "toxic int, word int, n int, h long, sentence binary"), folder, "sentences")
    turn = F.row_number().over(Window.partitionBy("word").orderBy("n", "h", "sentence"))  # short ones say more
    toxic = found.where("toxic = 1").distinct().withColumn("turn", turn).where(F.col("turn") <= toxic_landmarks).orderBy("turn", "word").limit(toxic_landmarks).collect()
    clean = found.where("toxic = 0").distinct().orderBy(F.col("n") > 6, "h", "sentence").limit(clean_landmarks).collect()
    marks = [bytes(r.sentence).split(b"\xff") for r in (*toxic, *clean)]
    vocabulary = Vocabulary.of(sorted({w for m in marks for w in m}), reach)
    at = {w: k for k, w in enumerate(vocabulary.names)}
    a = np.zeros((len(at), len(marks)))
    for j, m in enumerate(marks):
        for w in m:
            a[at[w], j] += 1
    gram = np.zeros((len(marks), len(marks)))
    offs = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary.names])]).astype(np.int64)
    for which, k in vocabulary.kernel(np.frombuffer(b"".join(vocabulary.names), np.uint8), offs):
        gram += a[which].T @ (k @ a)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    nystrom = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    coordinates = spark.sparkContext.broadcast(a)
    beta, bias = np.concatenate([np.full(len(toxic), 1 / max(len(toxic), 1)), np.full(len(clean), -1 / max(len(clean), 1))]), 0.0
    picks = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Model(vocabulary, a @ beta, bias, 1.0, 0.0, stops))
        got = texts.mapInArrow(_picked(shared, coordinates), "doc_id long, uid long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("uid", "ascending")])
        y, ids = got.column("y").to_numpy(), got.column("doc_id").to_pylist()
        pick = np.empty((len(got), len(marks)), np.float32)
        for k, b in enumerate(got.column("x")):
            pick[k] = np.frombuffer(b.as_py(), np.float32) @ nystrom
        picks.append(pick)
        del got
        x = np.concatenate([pick[y > 0], *(p[y <= 0] for p in picks)])
        w, bias = fit_svm(x, np.repeat([1, 0], [(y > 0).sum(), len(x) - (y > 0).sum()]))
        beta = nystrom @ w
        shared.destroy()
        del x
        cluster.release()
    coordinates.destroy()
    fold = np.array([zlib.crc32(str(d).encode()) // 5 % 4 for d in ids])
    margin = np.empty(len(y))
    for f in range(4):  # margins of texts that the fit has not seen
        held = fold == f
        own = ~held & (y > 0)
        x = np.concatenate([picks[-1][own], *(p[~held & (y <= 0)] for p in picks)])
        if held.any():
            w, b = fit_svm(x, np.repeat([1, 0], [own.sum(), len(x) - own.sum()])) if own.any() and (~held & (y <= 0)).any() else (np.zeros(len(marks)), 0.0)
            margin[held] = np.max([p[held] @ w for p in picks], axis=0) + b
    threshold = best_threshold(margin, y)
    cluster.drop_folder(spark, folder)
    return Model(vocabulary, a @ beta, float(bias) - threshold, fit_slope(margin - threshold, y), 0.0, stops)


def _score(shared):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in _slices(batch, 2):
                score = shared.value.score(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        cluster.release()

    return run


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.  Null is an empty text; only the text is an input.

    Repeated rows and null ids are rows like others; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (cluster.crc_mod(doc_id, 5) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def _clean(shared, column: int):
    def run(batches):
        for batch in batches:
            kept = [shared.value.score(data, offs) < 0.5 for _, _, data, offs in _slices(batch, column)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))
        cluster.release()

    return run


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(shared, docs.columns.index(text)), docs.schema)
