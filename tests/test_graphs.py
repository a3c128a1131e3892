import random

import pytest

EDGES = "src long, dst long"


def plain_topology(nodes, edges):
    """Levels by repeated relaxation of an acyclic rest, strong parts by mutual reach."""
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[n] = seen
    ring = {n: min(m for m in reach[n] if n in reach[m]) if n in reach[n] else None for n in out}
    stuck = {n for n in out if ring[n] is not None or any(ring[m] is not None and n in reach[m] for m in out)}
    level, before = {}, {n: {a for a, b in edges if b == n} for n in out}

    def of(n):
        if n not in level:
            level[n] = max((of(a) + 1 for a in before[n]), default=0)
        return level[n]

    return {n: (None if n in stuck else of(n), ring[n]) for n in out}


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, EDGES)


NESTED = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 7), (8, 9), (9, 9), (20, 1), (9, 30), (30, 31), (40, 41), (41, 42), (42, 40), (50, 50), (60, 61), (61, 62), (62, 63), (60, 63), (63, 64)]


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_topology_by_brute_force(spark, seed):
    from larkspur.operators.graphs import topology

    rng = random.Random(seed)
    n = 70 if seed else 80
    edges = NESTED if seed is None else [(rng.randrange(n), rng.randrange(n)) for _ in range(30 + 25 * seed)]
    if seed == 3:  # without cycles
        edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    nodes = list(range(n))
    df = tables(spark, [*nodes, *nodes[:3], None], [*edges, *edges[:4], (None, 1), (1, None)])
    got = {r.id: (r.level, r.ring) for r in topology(*df).collect()}
    assert got == plain_topology(nodes, set(edges))


def test_topology_of_a_long_chain_and_a_long_ring(spark):
    from larkspur.operators.graphs import topology

    n = 100_000
    i = spark.range(n)
    chain = i.where(f"id < {n - 1}").selectExpr("id * 7 as src", "(id + 1) * 7 as dst")
    ring = spark.range(5000).selectExpr("-1 - id as src", "-1 - (id + 1) % 5000 as dst")
    got = topology(i.selectExpr("id * 7 as id"), chain.union(ring))
    r = got.selectExpr("count(*) n", "count_if(id >= 0 and level = id / 7 and ring is null) right", f"count_if(id < 0 and level is null and ring = -5000) round").first()
    assert (r.n, r.right, r["round"]) == (n + 5000, n, 5000)


def test_descendants_and_findings(spark):
    from larkspur.operators.graphs import descendants, graph_findings, graph_summary

    _, edges = tables(spark, [], NESTED)
    got = sorted(r.id for r in descendants(edges, spark.createDataFrame([(4,), (60,)], "id long")).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 31, 61, 62, 63, 64]
    claims = spark.createDataFrame([("a", ["b", "x"]), ("b", ["a"]), ("c", ["c"]), ("d", []), ("d", None), ("e", ["d", "y", "y"])], "id string, dependencies array<string>")
    found = graph_findings(claims)
    assert sorted(map(tuple, found.collect())) == [("cyclic", "a", "a"), ("cyclic", "b", "a"), ("cyclic", "c", "c"), ("dangling", "a", "x"), ("dangling", "e", "y"), ("duplicate", "d", "d")]
    assert tuple(graph_summary(found).first()) == (False, 3, 2, 1, False)
    assert tuple(graph_summary(graph_findings(claims.limit(0))).first()) == (True, 0, 0, 0, True)
