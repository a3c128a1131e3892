import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
PIECES, BPE = Q.tokenizer_file("piece_bpe_32k.model"), Q.tokenizer_file("word_bpe_49k.json")
SHARED = " ".join(f"passage{i}" for i in range(70))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "   \n\t", "one", "the same words here again and again", "the same words here again and again", f"start {SHARED} end", f"other {SHARED} tail É 中 <|endoftext|> it's", SHARED, "a" * 5000 + " " + "ab " * 3000, "x. y,z\r\n Q1w2", "word " * 300, " ".join(f"w{i % 97}" for i in range(20000))]
    texts += [" ".join(f"t{(i * k) % 101}" for i in range(120)) for k in range(1, 12)]
    texts += [texts[13] + " more", "one extra " + texts[13], SHARED + " " + SHARED]
    return [(None if i == 3 else i, t, None if i % 7 == 0 else f"src{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing extra columns
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, shard string, blob int, ids int").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words_of(t):
    return WORD.findall(t or "")


def key(i):
    return -(1 << 63) if i is None else i


def test_pieces_round_trip_and_are_best(docs, rows):
    from larkspur.llm.lattice import Vocabulary, best_path
    from larkspur.llm.unigram_pieces import encode_pieces

    got = by_id(encode_pieces(docs, PIECES, decoded=True))
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].exact and got[i].decoded == (t or "") and len(got[i].ids) == got[i].n_pieces
    v = Vocabulary.load(PIECES)
    table = {p: (s, k) for k, (p, s) in enumerate(zip(v.pieces, v.scores)) if v.kinds[k] == 0}
    for unit in ("▁widgets", "▁▁▁x", "▁réseau中🪰"):
        raw = unit.encode()
        best = [(-math.inf, 0)] * (len(raw) + 1)
        best[0] = (0.0, 0)
        for a in range(len(raw)):
            for b in range(a + 1, len(raw) + 1):
                if raw[a:b] in table and best[a][0] + table[raw[a:b]][0] > best[b][0]:
                    best[b] = (best[a][0] + table[raw[a:b]][0], a)
            width = next((w for w in range(1, 5) if a + w == len(raw) or (raw[a + w] & 0xC0) != 0x80))
            if raw[a : a + width] not in table and (raw[a] & 0xC0) != 0x80 and best[a][0] + v.unknown_score > best[a + width][0]:
                best[a + width] = (best[a][0] + v.unknown_score, a)
        ids, _ = best_path(v, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert sum(v.scores[x] if v.kinds[x] == 0 else 0 for x in ids) + v.unknown_score * unit.count("🪰") == pytest.approx(best[-1][0])


def test_substring_dedup(docs, rows):
    from larkspur.llm.substring_dedup import dedup_substrings

    first = {}
    for i, t, _ in sorted(rows, key=lambda r: key(r[0])):
        w = words_of(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), key(i))
    got = by_id(dedup_substrings(docs, 50))
    for i, t, _ in rows:
        w = words_of(t)
        gone = [any(first[tuple(w[k : k + 50])] < key(i) for k in range(max(0, j - 49), min(j, len(w) - 50) + 1)) for j in range(len(w))]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))


def test_lattice_likelihood(docs, rows):
    from larkspur.llm.lattice_likelihood import score_documents

    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _, _ in rows}
    tokens = {i: words_of((t or "").translate(LOW)) + [None] for i, t, _ in rows}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    got = by_id(score_documents(docs, PIECES))
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert math.isfinite(r.score) and r.score < 0


def test_likelihood_by_brute_force(spark, docs, rows):
    from larkspur.llm import words as W
    from larkspur.llm.lattice import MARK, Vocabulary, expected_pieces, log_marginal
    from larkspur.llm.lattice_likelihood import ANCHOR, DISCOUNT, PRIOR, ROUNDS, adapted, score_documents

    vocabulary = Vocabulary.load(PIECES)
    keys = W.Keys.new(1)

    def lattice(f, logp, log_byte, words):
        units = [MARK + x.encode() for x in words]
        return f(vocabulary, logp, log_byte, np.frombuffer(b"".join(units), np.uint8), np.cumsum([0] + [len(u) for u in units]))

    def anchor(x):
        raw = np.frombuffer(x.encode(), np.uint8)
        return int(W.word_hashes(raw, np.array([0]), np.array([len(raw)]), keys)[0] >> np.uint64(40)) % ANCHOR == 0

    def runs(w):
        out = [[]]
        for x in w:
            out[-1].append(x)
            if anchor(x):
                out.append([])
        return [tuple(r) for r in out if r]

    tokens = [(i, words_of((t or "").translate(LOW))) for i, t, _ in rows]
    training = [w for i, w in tokens if zlib.crc32(str("" if i is None else i).encode()) % 10]
    c = Counter(x for w in training for x in w)
    weights = adapted(vocabulary, None, 1.0)
    for k in range(ROUNDS):
        weights = adapted(vocabulary, lattice(expected_pieces, *weights, sorted(c)), PRIOR[k])
    spelled = {x: p for x, p in zip(sorted({x for _, w in tokens for x in w}), lattice(log_marginal, *weights, sorted({x for _, w in tokens for x in w})))}
    n, v = sum(c.values()) + len(training), len(c) + 1
    all_runs = [r for w in training for r in runs(w)]
    phrases = {r: k for r, k in Counter(r for r in all_runs if len(r) > 1).items() if k > 1}
    kept = sum(phrases.values())
    theta = kept / (len(all_runs) + 1)
    assert kept

    class Same:
        @staticmethod
        def new(seed=None):
            return keys

    with pytest.MonkeyPatch.context() as m:
        m.setattr(W, "Keys", Same)
        got = by_id(score_documents(docs, PIECES, 50.0))
    for i, w in tokens:
        total, k, before = 0.0, 0, Counter()
        for r in runs(w):
            log = 0.0
            for x in r:
                p = (max(c[x] - DISCOUNT, 0) + DISCOUNT * v * math.exp(spelled[x])) / n
                log += math.log((50 * p + before[x]) / (50 + k))
                before[x] += 1
                k += 1
            arc = theta * phrases.get(r, 0) / kept
            total += np.logaddexp(math.log(1 - theta) + log, math.log(arc) if arc else -math.inf)
        total += math.log(50 * len(training) / n / (50 + k))
        assert got[i].score == pytest.approx(total / math.log(10), rel=1e-5)
        assert got[i].lattice_score == pytest.approx(sum(spelled[x] for x in w) / math.log(10), rel=1e-5, abs=1e-9)


def test_lattice_scores_agree_between_runs(spark):
    from larkspur.llm.lattice_likelihood import score_documents

    rng = np.random.default_rng(5)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"], 12)) for _ in range(20)]
    docs = spark.createDataFrame([(i, lines[i % 20] + " " + lines[i * 7 % 20]) for i in range(120)], "doc_id long, text string")
    one, two = (by_id(score_documents(docs, PIECES, 50.0)) for _ in range(2))
    assert one.keys() == two.keys() and all(one[i].score == pytest.approx(two[i].score, rel=1e-9) for i in one)


def test_expected_pieces_by_enumeration():
    from larkspur.llm.lattice import Vocabulary, expected_pieces

    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    p = np.log(np.array([0.3, 0.2, 0.2, 0.2, 0.1]))
    v = Vocabulary.of(pieces, p, np.zeros(5, np.int8))

    def paths(s):
        return [[]] if not s else [[k, *rest] for k, x in enumerate(pieces) if s.startswith(x) for rest in paths(s[len(x) :])]

    want = np.zeros(6)
    for s in (b"aba", b"b", b"abababba"):
        weights = [math.exp(sum(p[k] for k in path)) for path in paths(s)]
        for path, weight in zip(paths(s), weights):
            np.add.at(want, path, weight / sum(weights))
    got = expected_pieces(v, p, -9.0, np.frombuffer(b"aba" + b"b" + b"abababba", np.uint8), np.array([0, 3, 4, 12]))
    assert got == pytest.approx(want)


def test_marginal_sums_all_segmentations():
    from larkspur.llm.lattice import Vocabulary, log_marginal

    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    p = np.log(np.array([0.3, 0.2, 0.2, 0.2, 0.1]))
    v = Vocabulary.of(pieces, p, np.zeros(5, np.int8))

    def brute(s):
        return 1.0 if not s else sum(math.exp(q) * brute(s[len(x) :]) for x, q in zip(pieces, p) if s.startswith(x))

    for s in (b"a", b"aba", b"abababba"):
        assert log_marginal(v, p, -9.0, np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0] == pytest.approx(math.log(brute(s)))


def test_source_mix(docs, rows):
    from larkspur.llm.source_mix import mix_sources

    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {i: len(words_of(t)) for i, t, _ in rows}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    total = sum(size.values())
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert sum(g[0].target for g in by.values()) == pytest.approx(min(total, 3 * total))
    for g in by.values():
        assert g[0].target <= 3 * g[0].source_size + 1e-6 and abs(sum(r.taken for r in g) - g[0].target) <= 0.05 * g[0].target + 200
    assert sorted((key(r.doc_id), r.taken) for r in mix_sources(docs).collect()) == sorted((key(r.doc_id), r.taken) for r in got)


def test_token_store_and_rans(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    from larkspur.llm.rans import EVERY, LANES, Coder, Table
    from larkspur.llm.token_store import read_tokens, write_tokens

    write_tokens(docs, str(tmp_path / "t"), BPE, 2)
    got, t, start = by_id(read_tokens(spark, str(tmp_path / "t"), with_ids=True)), Tokenizer.from_file(BPE), 0
    for i, text, _ in sorted(rows, key=lambda r: key(r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids, got[i].ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.5, n).clip(max=900) for n in (1, LANES * EVERY * 2 + 5, 700)]
    coder = Coder(Table.of(*np.unique(np.concatenate(blocks), return_counts=True)))
    blobs = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(blobs)))
    assert np.array_equal(coder.decode([blobs[1]], checkpoint=1)[0], blocks[1][LANES * EVERY :])
    with pytest.raises(ValueError):
        coder.decode([blobs[2][:-1] + bytes([blobs[2][-1] ^ 1])])


def plain_kernel(a: str, b: str, reach: int = 9, decay: float = 0.8) -> float:
    """The normalised subsequence kernel by its definition, to the fourth power."""

    def phi(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + reach)):
                    out[w[i] + w[j] + w[k]] += decay ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(p[f] * q[f] for f in p)
    return (dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))) ** 4 if x and y else 0.0


def letters(words):
    return [bytes(ord(c) - 97 for c in w) for w in words]


def test_kernel_by_definition():
    from larkspur.llm.toxicity import Vocabulary

    names = ["idiot", "aaa", "moron", "abcabcabcabc", "z" * 30, "pathetic"]
    asked = ["idiot", "idxiot", "ab", "", "aaaa", "moronmoron", "q", "cba" * 9, "iiddiioott", ("pathetic" + "xyz") * 20]
    raw = letters(asked)
    got = np.zeros((len(asked), len(names)))
    for which, k in Vocabulary.of(letters(names)).kernel(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])):
        got[which] = k
    assert got == pytest.approx(np.array([[plain_kernel(a, b) for b in names] for a in asked]))


def test_margin_by_definition():
    from larkspur.llm.toxicity import LONGEST, Model, Vocabulary
    from larkspur.llm.words import text_parts

    import pyarrow as pa

    look = str.maketrans("013457@$!", "oleastasi")
    clean = lambda w: re.sub("[^a-z]", "", w.translate(LOW).translate(look))
    names, weights, stops = ["idiot", "moron", "fine"], np.array([2.0, 1.5, -1.0]), ["the"]
    model = Model(Vocabulary.of(letters(names)), weights, -0.5, 1.0, 0.0, frozenset(letters(stops)))
    texts = [None, "", " ", "the", "you idiot. a moron", "i d i o t and more", "i d\ni o t", "id1ot mor0n", "fine fine fine!\nan idiot", "IDIOT\x0bmoron", " ".join(["moron"] * 95), "é中 idéiot", "x" * 3000 + " idiot"]

    def margin(t):
        best = None
        for line in re.split("\n", t or ""):
            sentence = []
            every = []
            for w in words_of(line):
                sentence.append(w)
                if w[-1] in ".!?" or len(sentence) == LONGEST:
                    every.append(sentence)
                    sentence = []
            # a run of single characters belongs to the sentence of its last
            run, where = [], None
            extra = Counter()
            flat = [(w, k) for k, s in enumerate([*every, sentence]) for w in s]
            joined = []
            for w, k in [*flat, ("xx", -1)]:
                if len(w.encode()) == 1:
                    run.append(w)
                    where = k
                else:
                    if len(run) > 2:
                        joined.append(("".join(run), where))
                    run = []
            for k, s in enumerate([*every, sentence]):
                if s:
                    total = sum(c * plain_kernel(clean(w), n) for w in [*s, *(j for j, at in joined if at == k)] if clean(w) not in stops for c, n in zip(weights, names))
                    best = total if best is None else max(best, total)
        return (best or 0.0) - 0.5

    got = np.concatenate([model.margin(data, offs) for _, _, data, offs in text_parts(pa.array(texts, pa.string()))])
    assert got == pytest.approx(np.array([margin(t) for t in texts]), abs=1e-9)


def test_svm_finds_the_least_loss():
    from larkspur.llm.toxicity import best_threshold, fit_svm

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.3).astype(int)
    x[y > 0] += 1.5
    weigh = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum()) * 1000

    def loss(w, b):
        return 0.5 * w @ w + 0.5 * (weigh * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b)) ** 2).sum()

    w, b = fit_svm(x, y)
    assert all(loss(w, b) <= loss(w + d[:3], b + d[3]) + 1e-6 for d in rng.normal(size=(200, 4)) * 0.05)
    margin = x @ w + b
    cost = lambda t: ((margin < t) & (y > 0)).sum() + 2 * ((margin >= t) & (y <= 0)).sum()
    assert cost(best_threshold(margin, y)) == min(cost(t) for t in [*margin, margin.max() + 1])


def test_toxicity(spark):
    from larkspur.llm.toxicity import fit_toxicity, keep_clean, score_toxicity

    rng = np.random.default_rng(3)
    made = [(i, " ".join("".join(rng.choice(list("abcdefghmnorstuv"), rng.integers(3, 8))) for _ in range(40)), int(rng.random() < 0.2)) for i in range(600)]
    made = [(i, t + ". You " + str(rng.choice(["idiot", "moron", "loser"] if y else ["friend", "there", "what an", "such"])), y) for i, t, y in made]
    made += [(1000, "you i d i o t there", 1), (1001, "what an id.iot", 1), (1002, "such a mo-ron", 1), (1003, "", 0), (1004, None, 0), (1004, None, 0), (None, "you idiot", 1), (1005, "z" * 300000, 0)]
    docs = spark.createDataFrame([(*r[:2], "x", 1.0, 5) for r in made], "doc_id long, text string, uid string, score double, y int").repartition(4)
    labels = spark.createDataFrame([(i, y, 3) for i, _, y in made if i is not None and i < 1000] + [(None, 1, 3), (5000, None, 3)], "doc_id long, toxic int, y int")
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == len(made)
    got = {r.doc_id: r for r in rows}
    assert np.mean([got[i].predicted == y for i, _, y in made if i is not None and i < 1000 and got[i].held_out]) > 0.97
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 1]
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if not r.predicted)
    empty = fit_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in score_toxicity(docs, empty).collect()} == {0}
    assert score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("kind", ["cosine", "product"])
def test_vector_search(spark, kind):
    from larkspur.llm.vector_search import nearest_by_blocks, top_products

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[10] = v[11] = v[50]
    v[60:70] *= 1e200 if kind == "cosine" else 1e7
    v[70:80] *= 1e-200
    good = [(i, v[i].tolist()) for i in range(300)] + [(7, v[7].tolist()), (7, v[8].tolist()), (100, v[100].tolist()), (100, v[3].tolist())]
    bad = [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, []), (None, v[3].tolist()), (450, [float("inf")] * 8)] + ([(500, [0.0] * 8)] if kind == "cosine" else [])
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, score int, row string, floor int")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in (nearest_by_blocks(df) if kind == "cosine" else top_products(df)).collect())
    assert sum(got.values()) == 5 * 8
    want = []
    for a, (q, x) in enumerate(good):
        if q % 50 == 0:
            found = []
            for b, (i, y) in enumerate(good):
                if a != b and kind == "cosine":
                    s, t = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
                    found.append((-float(s @ t) / math.hypot(*s) / math.hypot(*t), i))
                elif a != b:
                    found.append((-sum(math.floor(256 * s) * math.floor(256 * t) for s, t in zip(x, y)), i))
            found.sort(key=lambda f: (round(f[0], 12), f[1]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    flat = sorted(x for x, n in got.items() for _ in range(n))
    for g, w in zip(flat, sorted(want)):
        assert g[:3] == w[:3] and (g[3] == w[3] if kind == "product" else g[3] == pytest.approx(w[3], abs=1e-12))


@pytest.mark.parametrize("probe", [False, True])
def test_queries_of_a_tile_meet_leaves_together(monkeypatch, probe):
    """Queries and copies by the hundred, against brute force, without a product for each query and leaf."""
    import pyarrow as pa

    from larkspur.llm import vector_search

    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 16))
    v[200:700] = v[100]
    v[700:1100] = v[3] + rng.normal(size=(400, 16)) * 0.01
    rows = [(0, 0, 16, query, i, i, v[i].tolist(), None) for i in rng.permutation(1500).tolist() for query in (False, True) if not query or i % 5 == 0]
    table = pa.Table.from_pylist([dict(zip(("cblock", "qblock", "d", "query", "row", "vec_id", "v", "floor"), r)) for r in rows], pa.schema([("cblock", pa.int32()), ("qblock", pa.int32()), ("d", pa.int32()), ("query", pa.bool_()), ("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("floor", pa.int64())]))
    monkeypatch.setattr(vector_search, "exact_products", None)
    monkeypatch.setattr(vector_search, "KEPT", 500, raising=False)
    whole = np.floor(256 * v).astype(np.int64)
    score = whole @ whole.T
    want = {q: sorted((-int(score[q, i]), i) for i in range(1500) if i != q)[:5] for q in range(0, 1500, 5)}
    got = {}
    for r in vector_search._product_tile(5, 256, probe)(None, table).to_pylist():
        assert r["row"] == r["query_id"] and r["score"] == score[r["query_id"], r["vec_id"]]
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    if probe:
        assert all(len(x) <= 5 for x in got.values())
    else:
        assert {q: sorted(x) for q, x in got.items()} == want
        floors = {q: -x[4][0] for q, x in want.items()}
        floor = pa.array([floors.get(q) for q in table.column("vec_id").to_pylist()], pa.int64())
        again = vector_search._product_tile(5, 256, False)(None, table.set_column(7, "floor", floor)).to_pylist()
        assert {q: sorted((-r["score"], r["vec_id"]) for r in again if r["query_id"] == q) for q in want} == want


def test_vector_search_of_empty_tables(spark):
    from larkspur.llm.vector_search import nearest_by_blocks, top_products

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_by_blocks(none).count() == top_products(none).count() == 0


def test_bytes_dedup(docs, rows):
    from larkspur.llm.suffix_dedup import dedup_bytes

    texts = {i: (t or "").encode() for i, t, _ in rows}
    count = Counter(x[k : k + 200] for x in texts.values() for k in range(len(x) - 199))
    got = by_id(dedup_bytes(docs, 200))
    for i, x in texts.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(x), sum(gone), kept)
        assert len(got[i].spans) == len(re.findall(b"\1+", bytes(gone)))


def test_ngram_join(docs, rows):
    from larkspur.llm.ngram_join import join_similar

    sets = {}
    for i, t, _ in rows:
        w = words_of((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b], key=key)
    got = by_id(join_similar(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}


def test_empty_tables(spark, docs, tmp_path):
    from larkspur.llm import lattice_likelihood, ngram_join, source_mix, substring_dedup, suffix_dedup, token_store, unigram_pieces

    none = docs.limit(0)
    token_store.write_tokens(none, str(tmp_path / "t"), BPE, 2)
    for out in (token_store.read_tokens(spark, str(tmp_path / "t")), lattice_likelihood.score_documents(none, PIECES), unigram_pieces.encode_pieces(none, PIECES), substring_dedup.dedup_substrings(none), source_mix.mix_sources(none), suffix_dedup.dedup_bytes(none), ngram_join.join_similar(none)):
        assert out.count() == 0


def test_source_mix_meets_targets(spark):
    from larkspur.llm.source_mix import mix_sources

    sizes = {"a": [40], "b": [400], "c": [700, 0, 641, 2], "d": [9000, 1, 8000], None: [1], "e": [64], "f": [65, 63]}
    rows = [(10 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (1, 64, 1200):
        by = {}
        for r in mix_sources(docs, block=block).collect():
            assert r.taken == sum(p.words * p.times for p in r.pieces or [])
            # each word is taken as often as its turns come round
            spans = [(p["first"], p["first"] + p["words"]) for p in r.pieces or []]
            assert all(0 <= a < b <= r.size for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
            assert r.size * (r.taken // max(r.size, 1)) <= r.taken <= 3 * r.size
            by.setdefault(r.source, []).append(r)
        assert {s: sum(r.taken for r in g) for s, g in by.items()} == {s: round(g[0].target) for s, g in by.items()}
        assert sum(r.taken for r in by["a"]) == 120 and sum(r.taken for r in by["b"]) == 1200


MIXED = {"a": [40], "b": [400, 33], "c": [700, 0, 641, 2], "d": [9000, 1, 8000], None: [1], "e": [64], "f": [65, 63]}


def mixed_docs(spark):
    rows = [(10 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(MIXED.items()) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block", [1, 64, 500])
def test_source_mix_follows_its_schedule(spark, block):
    """Slot by slot: the point's source, its next block, the words of each document in it."""
    from pyspark.sql import functions as F

    from larkspur.llm.source_mix import ONE, PHI, mix_sources

    docs = mixed_docs(spark)
    got = by_id(mix_sources(docs, block=block))
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(0), F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).alias("h")).collect()}
    sources = sorted(MIXED, key=lambda s: (s is None, s or ""))
    runs, goal, turns = {}, {}, {}
    for s in sources:
        mine = sorted((i for i, r in got.items() if r.source == s), key=order.get)
        runs[s] = [(i, w) for i in mine for w in range(got[i].size)]
        goal[s] = round(got[mine[0]].target)
        blocks = -(-len(runs[s]) // block)
        turns[s] = goal[s] // len(runs[s]) * blocks + -(-(goal[s] % len(runs[s])) // block)
    n = sum(turns.values())
    ends = np.cumsum([turns[s] for s in sources]).tolist()
    took, used, slots, given = Counter(), Counter(), {}, Counter()
    for slot in range(10 * n):
        s = next(s for s, e in zip(sources, ends) if slot * PHI % ONE < e * ONE // n)
        if used[s] < turns[s]:
            at = used[s] % -(-len(runs[s]) // block) * block
            for i, w in runs[s][at : at + block][: goal[s] - given[s]]:
                took[i, w] += 1
                given[s] += 1
                slots.setdefault(i, set()).add(slot)
            used[s] += 1
        if slot < n:  # every beginning of the mix is near the targets
            assert all(abs(used[s] - (slot + 1) * turns[s] / n) < 4 for s in sources)
    assert given == goal and max(max(x) for x in slots.values()) <= 17 * n // 8
    for i, r in got.items():
        assert r.taken == sum(took[i, w] for w in range(r.size))
        assert (r.first_slot, r.n_slots) == (min(slots.get(i, {None})), len(slots.get(i, ())))
        assert {w: p.times for p in r.pieces or [] for w in range(p["first"], p["first"] + p["words"])} == {w: took[i, w] for w in range(r.size) if took[i, w]}
        assert all(p.times == len(p.slots) and p.slots == sorted(p.slots) for p in r.pieces or [])
        assert {x for p in r.pieces or [] for x in p.slots} == slots.get(i, set())


@pytest.mark.parametrize("points", ["id", "one", "half"])
def test_source_mix_needs_its_points(spark, monkeypatch, points):
    """With other points than the schedule's the mix misses its targets."""
    from pyspark.sql import functions as F

    from larkspur.llm import source_mix

    monkeypatch.setattr(source_mix, "point", {"id": lambda slot: slot, "one": lambda slot: slot * 0, "half": lambda slot: F.pmod(slot, F.lit(2)) * (source_mix.ONE // 2)}[points])
    by = {}
    for r in source_mix.mix_sources(mixed_docs(spark)).collect():
        by.setdefault(r.source, []).append(r)
    assert any(abs(sum(r.taken for r in g) - g[0].target) > 0.2 * g[0].target for g in by.values())


def test_points_are_exact(spark):
    from pyspark.sql import functions as F

    from larkspur.llm.source_mix import ONE, PHI, point

    ids = [0, 1, 2, 1 << 20, (1 << 31) + 12345, (1 << 40) - 1]
    assert [r.p for r in spark.createDataFrame([(i,) for i in ids], "id long").select(point(F.col("id")).alias("p")).collect()] == [i * PHI % ONE for i in ids]


def thue_morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide_are_told_apart(spark, tmp_path):
    """Such words collide under any polynomial hash modulo 2**64."""
    from tokenizers import Tokenizer

    from larkspur.llm import lattice_likelihood, ngram_join, substring_dedup, token_store, unigram_pieces

    one, two = thue_morse("a", "b", 2048), thue_morse("b", "a", 2048)
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs, 50).collect()] == [0, 0]
    short = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in ngram_join.join_similar(short).collect()} == {1, 2}
    assert all(r.exact for r in unigram_pieces.encode_pieces(short, PIECES).collect())
    token_store.write_tokens(short, str(tmp_path / "t"), BPE, 2)
    t = Tokenizer.from_file(BPE)
    assert {r.doc_id: r.ids for r in token_store.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()} == {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in ((1, one), (2, two))}
    more = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {one}")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in lattice_likelihood.score_documents(more, PIECES).collect()}
    assert got[1].lattice_score != got[2].lattice_score and got[3].lattice_score == pytest.approx(2 * got[1].lattice_score, rel=1e-6)


def test_hashes_are_sums_modulo_a_prime():
    from larkspur.llm import words as W

    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, W.PRIME, 1000).astype(np.uint64) for _ in range(2))
    a[:2], b[:2] = W.PRIME - 1, W.PRIME - 1
    assert W.times(a, b).tolist() == [int(x) * int(y) % W.PRIME for x, y in zip(a, b)]
    values = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    base = 123456789012345678
    want, total = [0], 0
    for k, x in enumerate(values.tolist()):
        total = (total + x * pow(base, k, W.PRIME)) % W.PRIME
        want.append(total)
    assert W.prefix_sums(values, base).tolist() == want
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    ends = np.sort(rng.choice(np.arange(1, 4000), 900, replace=False))
    starts, raw = np.concatenate([[0], ends[:-1]]), raw[: ends[-1]]
    h = W.word_hashes(raw, starts, ends, W.Keys.new(3))
    by = {}
    for s, e, x in zip(starts, ends, h.tolist()):
        assert by.setdefault(raw[s:e].tobytes(), x) == x
    assert len(set(by.values())) == len(by)
    code, sample = W.distinct_words(raw, starts, ends)
    assert all(raw[starts[s] : ends[s]].tobytes() == raw[a:b].tobytes() for s, a, b in zip(sample[code], starts, ends))
    assert len(sample) == len(by) == code.max() + 1


def test_long_units_run_in_blocks():
    from larkspur.llm import lattice as L

    v = L.Vocabulary.load(PIECES)
    raw = ("▁" + "".join(np.random.default_rng(4).choice(list("abcdeéü中🪰 tion"), 3000)).replace(" ", "▁")).encode()
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    logp, log_byte = v.zipf()
    want, total = L.best_path(v, data, offs), L.log_marginal(v, logp, log_byte, data, offs)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(L, "LONG", 100)
        m.setattr(L, "BLOCK", 257)
        got = L.best_path(v, data, offs)
        assert np.array_equal(got[0], want[0]) and got[1].tolist() == want[1].tolist()
        assert L.log_marginal(v, logp, log_byte, data, offs) == pytest.approx(total)


def test_targets_by_water_filling(spark):
    from larkspur.llm.source_mix import mix_sources

    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        sizes = rng.integers(1, 4000, n) // rng.choice([1, 40], n) + 1
        weights = [1 + k % 3 for k in range(n)]
        target, open_ = np.zeros(n), set(range(n))
        left = float(sizes.sum())
        while open_:
            share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
            over = {k for k in open_ if share[k] > 3 * sizes[k]}
            for k in over or open_:
                target[k] = 3 * sizes[k] if over else share[k]
                left -= target[k]
            open_ -= over or set(open_)
        docs = spark.createDataFrame([(k, " ".join(["w"] * int(s)), f"s{k}") for k, s in enumerate(sizes)], "doc_id long, text string, source string")
        got = by_id(mix_sources(docs))
        assert [got[k].target for k in range(n)] == pytest.approx(target.tolist())


def test_whole_texts_have_best_pieces(spark):
    from larkspur.llm.lattice import MARK, Vocabulary
    from larkspur.llm.unigram_pieces import encode_pieces

    v = Vocabulary.load(PIECES)
    table = {p: v.scores[k] for k, p in enumerate(v.pieces) if v.kinds[k] == 0}
    longest = max(map(len, table))
    texts = ["The same words, here again", "  two  spaces\tand\na line ", "réseau 中文 🪰 x", "a" * 400, "", None]
    got = by_id(encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES))
    for i, t in enumerate(texts):
        raw = (MARK + t.encode().replace(b" ", MARK)) if t else b""
        best = [0.0] + [-math.inf] * len(raw)
        for b in range(1, len(raw) + 1):
            for a in range(max(0, b - longest), b):
                if raw[a:b] in table:
                    best[b] = max(best[b], best[a] + table[raw[a:b]])
            a = b - 1
            while a and raw[a] & 0xC0 == 0x80:
                a -= 1
            if (b == len(raw) or raw[b] & 0xC0 != 0x80) and raw[a:b] not in table:
                best[b] = max(best[b], best[a] + v.unknown_score)
        unknown = sum(1 for c in (t or "") if c != " " and c.encode() not in table)
        score = sum(v.scores[x] for x in got[i].ids if v.kinds[x] == 0) + unknown * v.unknown_score
        assert score == pytest.approx(best[-1]) and got[i].exact


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stage_rows():
    rng = np.random.default_rng(1)
    line = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 9999, n))
    copy, shared, alone, long = line(90), line(60), line(80), line(30000)
    near = copy.replace(copy.split()[40], "changed", 1)
    texts = [(1, copy), (None, copy), (2, copy), (3, f"{line(40)} {shared} {line(30)}"), (None, f"{shared} {line(50)}"), (None, alone), (None, alone), (None, "short one"), (4, line(70)), (None, None), (5, ""), (6, near), (7, line(60)), (7, line(65)), (8, alone + " x"), (8, alone + " x"), (9, long), (10, long + " end"), (11, " "), (11, " ")]
    return [(i, t, "en", None if k % 5 == 4 else f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(texts)]


def stage_input(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", uid int, row_key string").repartition(3)


def nulls_first(x):
    return (x is not None, x)


def test_stage_near_duplicates(spark, stage_rows):
    import corpus_pipeline as P

    got = [tuple(r) for r in P.near_duplicates(spark, stage_input(spark, stage_rows), "").collect()]
    sets = []
    for _, t, *_ in stage_rows:
        w = words_of((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    group = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    group[a] = group[b] = min(group[a], group[b])
    # one of the smallest id of each group, rows without words all
    assert Counter(r[0] for r in got) == Counter(min((stage_rows[k][0] for k in range(len(sets)) if group[k] == g), key=nulls_first) for g in set(group) if sets[g]) + Counter(r[0] for r, s in zip(stage_rows, sets) if not s)
    assert not Counter(got) - Counter(stage_rows)
    assert P.near_duplicates(spark, stage_input(spark, stage_rows).limit(0), "").count() == 0


def test_stage_repeated_passages(spark, stage_rows):
    import corpus_pipeline as P

    first = {}
    for r in sorted(stage_rows, key=lambda r: key(r[0])):
        w = words_of(r[1])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), key(r[0]))
    want = []
    for i, t, lang, source, n in stage_rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone[k : k + 50] = [True] * 50
        text = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t
        want.append((i, text, lang, source, len(text) if any(gone) else n))
    got = [tuple(r) for r in P.repeated_passages(spark, stage_input(spark, stage_rows), "").collect()]
    assert Counter(got) == Counter(want) and any(r[1] != w[1] for r, w in zip(stage_rows, want))
    assert P.repeated_passages(spark, stage_input(spark, stage_rows).limit(0), "").count() == 0


def test_stage_source_mix(spark, stage_rows):
    import corpus_pipeline as P

    from larkspur.llm.source_mix import mix_sources

    rows = [r for r in stage_rows if r[0] not in (9, 10)] + [stage_rows[3]] * 2
    mixed = [tuple(r) for r in P.source_mix(spark, stage_input(spark, rows), "").collect()]
    want, got, sizes = Counter(), Counter(), Counter()
    for r in mix_sources(stage_input(spark, rows)).groupBy("source").agg({"target": "max"}).collect():
        want[r[0]] = round(r[1])
    for r in mixed:
        assert words_of(r[1]) and r[4] == len(r[1])
        got[r[3]] += len(words_of(r[1]))
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in want.items() if n}
    before, after = Counter(), Counter()
    for i, t, _, s, _ in rows:
        before.update((i, s, w) for w in words_of(t))
    for i, t, _, s, _ in mixed:
        after.update((i, s, w) for w in words_of(t))
    # all words of a source whose target is its size or more come through, repeated rows each, and none more than 3 times
    assert not Counter({k: n for k, n in before.items() if want[k[1]] >= sizes[k[1]]}) - after
    assert all(after[k] <= 3 * before[k] for k in after)
    assert P.source_mix(spark, stage_input(spark, rows).limit(0), "").count() == 0


def test_stages_toxicity_and_pieces(spark, stage_rows, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghmnorstuv"), rng.integers(3, 8)))
    made = [(100 + i, " ".join([*(word() for _ in range(20)), *(["idiot"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(300)]
    spark.createDataFrame([(i, 1, y) for i, _, y in made], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = stage_rows + [(i, t, "en", "s", len(t)) for i, t, _ in made]
    kept = [tuple(r) for r in P.toxicity(spark, stage_input(spark, rows), str(tmp_path)).collect()]
    toxic = {i for i, _, y in made if y}
    gone = Counter(r[0] for r in rows) - Counter(r[0] for r in kept)
    assert not Counter(kept) - Counter(rows) and set(gone) <= toxic and sum(gone.values()) >= 0.95 * len(toxic)
    pieces = P.pieces(spark, spark.createDataFrame(kept, COLUMNS), "")
    assert Counter(r.doc_id for r in pieces.collect()) == Counter(r[0] for r in kept) and pieces.where("not exact").count() == 0
    assert P.toxicity(spark, stage_input(spark, rows).limit(0), str(tmp_path)).count() == P.pieces(spark, spark.createDataFrame([], COLUMNS), "").count() == 0


def test_mix_is_computed_by_plans_of_few_shuffles(spark):
    """Its parts are written; one plan of all of them takes the driver's memory where partitions are many."""
    import corpus_pipeline
    from larkspur.llm.source_mix import mix_sources

    docs = spark.createDataFrame([(i, f"w{i} " * (i % 90), "en", f"s{i % 3}", i) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for out in (mix_sources(docs), corpus_pipeline.source_mix(spark, docs, "")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and len(re.findall(r"\bExchange|BroadcastExchange", plan)) <= 6
