import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from larkspur.llm import queries as Q

SF = "/root/testdata/sf0.001"
BPE = Q.tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_registered_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert Counter(ours[theirs.columns].itertuples(index=False, name=None)) == Counter(theirs.itertuples(index=False, name=None))


def plain_best_fit(lengths, limits, weights):
    """Vector best-fit by its definition, piece by piece: how many sequences it needs."""
    top = np.array([limits.tokens, limits.documents, limits.attention], float)
    bins = []
    for k in sorted(lengths, reverse=True):
        ask = np.array([k, 1, k * k])
        fits = [b for b in bins if (b >= ask).all()]
        if fits:
            fits = min(fits, key=lambda b: (((b - ask) / top) ** 2 @ np.array(weights)))
        else:
            fits = top.astype(np.int64)
            bins.append(fits)
        fits -= ask
    return len(bins)


@pytest.mark.parametrize("limits", [(50, 100, 2500), (50, 3, 2500), (50, 100, 900)])
def test_best_fit_of_counts_is_best_fit_of_pieces(limits):
    from larkspur.llm.best_fit import WEIGHTS, Limits, best_fit, least

    limits, rng = Limits(*limits), np.random.default_rng(3)
    lengths = rng.integers(1, limits.longest() + 1, 400).tolist() + [7] * 200
    counts = Counter(lengths)
    for measure in ("norm", "dot"):
        plan, used = best_fit(counts, limits, measure)
        held = {}
        for length, first, n, copies, sequence, offset in plan.tolist():
            for k in range(n):
                held.setdefault(sequence + k // copies, []).append((offset + k % copies * length, length))
        assert Counter(k for s in held.values() for _, k in s) == counts and sorted(held) == list(range(used))
        for s in held.values():
            assert len(s) <= limits.documents and sum(k * k for _, k in s) <= limits.attention
            assert [o for o, _ in sorted(s)] == [sum(k for _, k in sorted(s)[:i]) for i in range(len(s))]
            assert sum(k for _, k in s) <= limits.tokens
        assert used >= least(counts, limits)
        if measure == "norm":
            assert used == plain_best_fit(lengths, limits, WEIGHTS)


TEXTS = [None, "", " \n", "one", "the same words", "the same words", "É 中 it's <|endoftext|>", "word " * 9000, "x" * 4095, *(f"t{i} " * (i * 37 % 900) for i in range(120))]


@pytest.mark.parametrize("limits", [None, (64, 4, 2000)])
def test_packing(spark, limits):
    from tokenizers import Tokenizer

    from larkspur.llm.best_fit import Limits, pack_documents

    limits = Limits(*limits) if limits else Limits()
    rows = [(None if i == 3 else i // 2 * 2 if i > 100 else i, t) for i, t in enumerate(TEXTS)] + [(5, "the same words"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, length int, rank int, ids string").repartition(5)
    got = pack_documents(docs, BPE, 1, limits, with_ids=True).collect()
    t, most = Tokenizer.from_file(BPE), limits.longest()
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.update((i, k, k * most, tuple(ids[k * most : (k + 1) * most])) for k in range(-(-len(ids) // most)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    held = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in held.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [k for _, k in s])[:-1].tolist()
        assert sum(k for _, k in s) <= limits.tokens and len(s) <= limits.documents and sum(k * k for _, k in s) <= limits.attention
    total = sum(len(x[3]) * n for x, n in want.items())
    assert len(held) >= -(-total // limits.tokens) and (limits.documents < 9 or len(held) <= -(-total // limits.tokens) + 1)
    assert pack_documents(docs.limit(0), BPE, 1, limits).count() == 0


def test_packing_refuses_limits_that_hold_nothing():
    from larkspur.llm.best_fit import Limits

    assert Limits(4096, 1, 100).longest() == 10
    with pytest.raises(ValueError):
        Limits(0, 1, 1).longest()


def brute_negatives(rows, every, k, m, least=30, largest=90):
    whole = lambda v: [min(max(math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(1 << 62, x)), -(1 << 62)), 1 << 62) for x in v]
    rows = [(i, lab, whole(v)) for i, lab, v in rows]
    out = []
    for a, (i, lab, x) in enumerate(rows):
        if i % every == 0:
            scored = sorted((-min(max(sum(p * q for p, q in zip(x, y)), -(1 << 63)), (1 << 63) - 1), j, other) for b, (j, other, y) in enumerate(rows) if b != a and len(x) == len(y))
            for s, j, _ in [r for r in scored if r[2] == lab][:k]:
                near = [r for r in scored if r[2] != lab and least * -s <= 100 * -r[0] <= largest * -s][:m]
                out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    from larkspur.llm import hard_negatives as H

    if small:  # several groups in a cell, many tiles
        monkeypatch.setattr(H, "GROUP", 3)
        monkeypatch.setattr(H, "TILE", 20)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 5)) * 2
    v = centre[rng.integers(0, 6, 500)] + rng.normal(size=(500, 5)) * 0.2
    v[40:140] = v[40]  # a crowd of copies
    good = [(i, int(i % 3 if i < 400 else 0), v[i].tolist()) for i in range(500)]
    good += [(10, 1, v[10].tolist()), (10, 1, v[10].tolist()), (11, 2, [0.0] * 5), (20, 0, [0.0] * 5), (-30, 0, (-v[3]).tolist()), (610, 1, [1.0, 2.0]), (611, 1, [2.0, 1.0]), (612, 0, [1.5, 0.2])]
    bad = [(700, 1, None), (710, None, v[1].tolist()), (None, 1, v[1].tolist()), (720, 1, [float("nan")] * 5), (730, 1, [None] * 5), (740, 1, []), (750, 1, [float("-inf")] * 5)]
    schema = "vec_id long, label int, embedding array<double>, row string, d int, cell int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in good + bad], schema).repartition(4)
    got = H.mine_negatives(df, H.Task(10, 5, 10))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(good, 10, 5, 10)
    assert H.mine_negatives(df.limit(0)).count() == H.mine_negatives(df.where("vec_id = 11")).count() == 0


def test_hard_negatives_of_very_large_entries(spark):
    from larkspur.llm import hard_negatives as H

    rng = np.random.default_rng(9)
    v = rng.normal(size=(40, 3))
    v[:6] *= 1e13
    v[6] *= 1e305
    rows = [(i, i % 2, v[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in H.mine_negatives(df, H.Task(4, 3, 4, 10, 100)).collect()) == brute_negatives(rows, 4, 3, 4, 10, 100)
    with pytest.raises(ValueError):
        H.Task(least=90, largest=30)


def test_few_candidates_are_copied_to_groups_that_they_cannot_serve(spark):
    """Well separated clusters: the bounds leave far fewer copies than groups times rows."""
    from larkspur.llm import cluster
    from larkspur.llm import hard_negatives as H

    rng = np.random.default_rng(2)
    at = rng.integers(0, 3, 2000)
    v = np.eye(8)[at] * 10 + rng.normal(size=(2000, 8)) * 0.05
    df = spark.createDataFrame([(i, int(at[i]), v[i].tolist()) for i in range(2000)], "vec_id long, label int, embedding array<double>")
    search = H.dealt_to_cells(H.whole_rows(df, 256.0, 20, "vec_id", "embedding", "label"), H.Task(20), cluster.shared_folder(spark))
    (cells,) = search.cells.values()
    near = {8: (np.zeros(cells.first[-1]), np.full(cells.first[-1], 10.0 * 256))}
    copies = search.rows.mapInArrow(H._dealt(search.cells, search.width, near), H.DEALT).count()
    assert copies < 0.5 * 2000 * (cells.first[-1] - 1)


def plain_whitening(x, most):
    n = len(x)
    c = (x - x.astype(object).sum(axis=0) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    return c @ v[:, ::-1][:, :most] / np.sqrt(e[::-1][:most]), e[::-1][:most] / e.sum()


def test_whitening(spark, monkeypatch):
    from larkspur.llm import whitening as W

    monkeypatch.setattr(W, "FAN", 2)  # a tree of several levels
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 3
    good = [(i if i else None, v[i].tolist()) for i in range(700)] + [(7, v[7].tolist()), (7, v[8].tolist())]
    other = [(900 + i, rng.normal(size=2).tolist()) for i in range(9)]  # of another dimension
    bad = [(800, None), (801, [None] * 6), (802, [float("nan")] * 6), (803, []), (804, [float("inf")] + [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in good + bad + other], "vec_id long, embedding array<double>, n int, component string, d int").repartition(9)
    got = W.whiten(df, components=4).collect()
    x = np.floor(64 * np.array([g[1] for g in good])).astype(int) + 1_000_000
    want, share = plain_whitening(x, 4)
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    rows = {}
    for r in got:
        if not (r.vec_id or 0) >= 900:
            assert r.n == len(x) and r.identity_error < 1e-9
            assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
            rows.setdefault((r.vec_id, r.deviation), Counter())[r.component] += 1
    assert Counter({k: c[1] for k, c in rows.items()}) == Counter(zip([g[0] for g in good], deviation.tolist()))
    assert all(sorted(c) == [1, 2, 3, 4] for c in rows.values())
    for k in range(4):
        ours = np.sort([r.whitened for r in got if r.component == k + 1 and not (r.vec_id or 0) >= 900])
        assert min(np.abs(ours - np.sort(s * want[:, k])).max() for s in (1, -1)) < 1e-9
    assert Counter(r.component for r in got if (r.vec_id or 0) >= 900) == {1: 9, 2: 9}
    assert W.whiten(df.limit(0)).count() == W.whiten(df.where("vec_id = 5")).count() == 0


def test_whitening_of_few_directions_and_of_very_large_entries(spark):
    from larkspur.llm import whitening as W

    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = W.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and max(r.explained for r in got) == pytest.approx(1)
    big = [[1e300, 1.0], [-1e300, 2.0], [3e15, 3.0], [0.0, 4.0]]
    got = {r.vec_id: r.deviation for r in W.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")).collect()}
    x = [[min(max(int(64 * c), -(1 << 62)), 1 << 62) + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: min(sum((4 * c - t) ** 2 for c, t in zip(v, s)), (1 << 63) - 1) for i, v in enumerate(x)}


def test_registered_whitening_query(spark):
    got = Q.op13_tsqr_whitening(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(table.embedding.tolist(), float)).astype(int) + 1_000_000
    want, _ = plain_whitening(x, 32)
    ours = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].values
    assert np.abs(ours * np.sign((ours * want).sum(axis=0)) - want).max() < 1e-8
    assert got.identity_error.max() < 1e-9 and got.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[table.vec_id].tolist() == ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()
