import numpy as np
import pytest


def signs(v):
    return np.asarray(v) >= 0


@pytest.mark.parametrize("dim,flips", [(64, 1), (40, 3), (100, 0)])
def test_nearest_codes_are_exact(spark, tmp_path, dim, flips):
    from pyspark.sql import functions as F

    from larkspur.operators import codes as C

    rng = np.random.default_rng(dim)
    base = rng.normal(size=(25, dim))
    v = base[rng.integers(0, 25, 600)] + rng.normal(size=(600, dim)) * 0.3
    v[100:300] = v[100]  # a crowd of copies
    rows = [(i, v[i].tolist()) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None), (901, [1.0])], "id long, v array<double>")
    asked = [(i, v[i].tolist()) for i in (0, 1, 2, 100, 101)] + [(7000 + i, rng.normal(size=dim).tolist()) for i in range(3)]
    q = spark.createDataFrame(asked, "query long, v array<double>")
    C.write_codes(*C.code_index(df, dim), str(tmp_path / "i"))
    index = C.read_codes(spark, str(tmp_path / "i"))
    got = C.nearest_codes(*index, q.select("query", C.code_of(F.col("v"), dim).alias("code")), 10, dim, flips)
    want = []
    for name, x in asked:
        far = sorted((int((signs(x) != signs(y)).sum()), i) for i, y in rows)
        want += [(name, i, d) for d, i in far[:10]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert C.nearest_codes(*C.code_index(df.limit(0), dim), q.select("query", C.code_of(F.col("v"), dim).alias("code")), 10, dim, flips).count() == 0


def test_recall_after_rescoring(spark):
    from larkspur.operators import codes as C

    rng = np.random.default_rng(7)
    n, dim = 12_000, 64  # beyond the gate of 10,000
    base = rng.normal(size=(600, dim))
    v = base[rng.integers(0, 600, n)] + rng.normal(size=(n, dim)) * 0.45
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>").repartition(8)
    asked = list(range(0, n, 300))
    q = spark.createDataFrame([(i, v[i].tolist()) for i in asked], "query long, v array<double>")
    got = {}
    for r in C.indexed_search(df, q, 10, dim, prefilter=50).collect():
        got.setdefault(r["query"], set()).add(r.id)
    best = {i: set(np.argsort(-(v @ v[i]), kind="stable")[:10].tolist()) for i in asked}
    recall = np.mean([len(got[i] & best[i]) / 10 for i in asked])
    print("recall@10", recall)
    assert recall >= 0.9


def test_scan_by_blocks_is_exact(spark, monkeypatch):
    """Codes without clusters in blocks of a few, many at one distance: a tile gives out k rows a query."""
    from larkspur.operators import codes as C

    monkeypatch.setattr(C, "BLOCK", 90)
    monkeypatch.setattr(C, "ASKED", 7)
    rng = np.random.default_rng(3)
    code = rng.integers(-(2**63), 2**63 - 1, (400, 2))
    code[50:90] = code[50]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(code.tolist())], "id long, code array<long>")
    asked = spark.createDataFrame([(i, code[i].tolist()) for i in range(0, 400, 17)], "query long, code array<long>")
    got = {}
    for r in C.scanned(df, asked, 5).collect():
        got.setdefault(r["query"], []).append((r.distance, tuple(r.code)))
    first = {tuple(c): i for i, c in reversed(list(enumerate(code.tolist())))}
    apart = lambda a, b: sum(int(x & (2**64 - 1)).bit_count() for x in (int(p) ^ int(q) for p, q in zip(a, b)))
    for q in range(0, 400, 17):
        want = sorted((apart(code[q], c), i, c) for c, i in first.items())[:5]
        assert sorted(got[q]) == sorted((d, c) for d, _, c in want)
