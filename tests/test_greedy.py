"""Greedy selections and betweenness in rounds against the loop."""

import random

import pytest

from strandline.operators.greedy import apart, independent


@pytest.mark.parametrize("seed", [1, 2])
def test_independent_equals_the_loop(spark, seed):
    """Random graphs with ties and null priorities, a chain, a hub with a third of all links, loops, repeated links, strangers."""
    rng = random.Random(seed)
    rows = [(v, None if rng.random() < 0.1 else rng.randrange(40) / 40, "clash") for v in range(150)]
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(160)] + [(7, v) for v in range(80)] + [(v, v + 1) for v in range(100, 110)] + [(3, 3), (5, 999), (None, 4)]
    links += links[:20] + [(b, a) for a, b in links[20:40]]
    got = {r["v"] for r in independent(spark.createDataFrame(rows, "v long, p double, a string"), spark.createDataFrame(links, "a long, b long"), ["p"]).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    kept = set()
    for v, _, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        if not near.get(v, set()) & kept:
            kept.add(v)
    assert got == kept
    df = spark.createDataFrame(rows, "v long, p double, a string")
    assert independent(df, spark.createDataFrame([], "a long, b long"), ["p"]).count() == 150


@pytest.mark.parametrize("distance", [0, 7, 60])
def test_apart_equals_the_loop(spark, distance):
    """Positions on, before and beyond the edges of bins, below zero, alike; a hot bin; ties and null priorities."""
    rng = random.Random(distance)
    rows = [(rng.choice(["1", "2"]), rng.randrange(-300, 600), None if rng.random() < 0.05 else rng.randrange(30) / 30, k) for k in range(300)] + [("1", rng.randrange(100, 107), rng.random(), 1000 + k) for k in range(150)] + [("1", 50, 0.5, 2000), ("1", 50, 0.5, 2001)]
    df = spark.createDataFrame([*rows, (None, 3, 0.1, -1), ("1", None, 0.1, -2)], "chr string, pos long, pval double, k long")
    got = sorted((r["chr"], r["pos"], r["pval"]) for r in apart(df, distance, ["pval"]).select("chr", "pos", "pval").collect() if r["pval"] is not None)
    kept = []
    for c, pos, p, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
        if all(c != x or abs(pos - y) > distance for x, y, _ in kept):
            kept.append((c, pos, p))
    assert got == sorted(x for x in kept if x[2] is not None)
    assert apart(df, distance, ["pval"]).count() == len(kept) and apart(df.limit(0), 5, ["pval"]).columns == df.columns


@pytest.mark.parametrize("kind", ["random", "path", "star", "two", "none"])
def test_path_betweenness_equals_the_loop(spark, kind):
    from strandline.operators.graph import adjacency, betweenness, path_betweenness

    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(40, 41), (41, 42), (3, 3), (42, 41)],
        "path": [(k, k + 1) for k in range(9)],
        "star": [(0, k) for k in range(1, 40)] + [(50, 51)],
        "two": [(1, 2)],
        "none": [(1, 1)],
    }[kind]
    want = betweenness(adjacency((a, b, 1.0) for a, b in edges))
    n = len(want)
    got = {r["node"]: r["paths_through"] for r in path_betweenness(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(want) and all(got[v] == pytest.approx(x * max((n - 1) * (n - 2), 1), abs=1e-9) for v, x in want.items())
