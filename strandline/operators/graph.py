"""Graph algorithms: set-at-a-time ones over edge tables, sequential ones as plain functions for groups of one graph."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import cut, written


def symmetric(edges: DataFrame, a: str = "a", b: str = "b", *columns: str) -> DataFrame:
    """Both directions of undirected edges."""
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), *columns).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b"), *columns))


def connected_components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable. Labels spread and jump through labels; lineage is checkpointed."""
    both = symmetric(edges).where("a != b").distinct()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), "l")
    both = cut(both)
    before = None
    for _ in range(max_steps):
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(spread, F.col("node") == F.col("a"), "left").select("node", F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = new.join(new.select(F.col("node").alias("l"), F.col("l").alias("ll")), "l", "left").select("node", F.least("l", F.coalesce("ll", "l")).alias("l"))
        labels = cut(jump)
        total = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"connected_components: no end after {max_steps} steps")
    return labels.select("node", F.col("l").alias("component"))


def degree_centrality(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(node, degree, strength)"""
    return symmetric(edges, "a", "b", weight).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum(weight).alias("strength"))


def pagerank(edges: DataFrame, weight: str = "w", damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """(node, rank) of an undirected weighted graph, summing to 1; a fixed number of joins, checkpointed every tenth."""
    both = symmetric(edges, "a", "b", weight)
    out = both.groupBy("a").agg(F.sum(weight).alias("total"))
    step = cut(both.join(out, "a").select("a", "b", (F.col(weight) / F.col("total")).alias("p")))
    n = out.count()
    rank = out.select(F.col("a").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        moved = step.join(rank, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("p") * F.col("rank")).alias("m"))
        rank = moved.select(F.col("b").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("m")).alias("rank"))
        if k % 10 == 9:
            rank = cut(rank)
    return rank


def path_betweenness(edges: DataFrame) -> DataFrame:
    """(node, paths_through): of an undirected graph of any size, the sum over ordered pairs of other nodes of the share of their
    shortest paths (in edges) that pass the node. Divided by (n - 1)(n - 2) it is betweenness().

    From all nodes at once: a table for each distance holds (source, node, number of shortest paths); of undirected edges only
    the last two tables can hold a neighbour again. Then the shares are summed back from the farthest table to the nearest.
    Tables hold a row for each two nodes that reach each other, as the exact result needs; rounds are twice the diameter."""
    both = written(symmetric(edges).where("a <> b").distinct())
    front = written(both.select(F.col("a").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))
    levels = [front]
    while True:
        step = front.join(both, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:
            step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = written(step)
        if front.isEmpty():
            break
        levels.append(front)
    out, held = None, levels[-1].withColumn("share", F.lit(0.0))
    for nearer in [*levels[-2:0:-1], None] if len(levels) > 1 else []:
        here = held.select("node", "share")
        out = here if out is None else out.union(here)
        if nearer is None:
            break
        up = held.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), ((1 + F.col("share")) / F.col("paths")).alias("x"))
        sums = up.groupBy("source", "node").agg(F.sum("x").alias("x"))
        held = written(nearer.join(sums, ["source", "node"], "left").select("source", "node", "paths", (F.coalesce("x", F.lit(0.0)) * F.col("paths")).alias("share")))
    zero = levels[0].select("node", F.lit(0.0).alias("share"))
    return (zero if out is None else out.union(zero)).groupBy("node").agg(F.sum("share").alias("paths_through"))


def adjacency(edges) -> dict:
    """{a: {b: w}} of undirected (a, b, w) rows."""
    g: dict = defaultdict(dict)
    for a, b, w in edges:
        if a != b:
            g[a][b] = g[b][a] = float(w)
    return g


def betweenness(g: dict, weighted: bool = False) -> dict:
    """Brandes' algorithm, normalised; weighted: edge weights are lengths."""
    out = dict.fromkeys(g, 0.0)
    for s in g:
        order, before, paths, dist = [], defaultdict(list), defaultdict(float), {}
        paths[s] = 1.0
        if weighted:
            far, heap, tick = {s: 0.0}, [(0.0, 0, s)], 0
            while heap:
                d, _, v = heapq.heappop(heap)
                if v in dist:
                    continue
                dist[v] = d
                order.append(v)
                for w, length in g[v].items():
                    at = d + length
                    if w not in dist and (w not in far or at < far[w] - 1e-15):
                        far[w], before[w], paths[w], tick = at, [v], paths[v], tick + 1
                        heapq.heappush(heap, (at, tick, w))
                    elif w not in dist and abs(at - far[w]) <= 1e-15:
                        before[w].append(v)
                        paths[w] += paths[v]
        else:
            dist, todo = {s: 0}, deque([s])
            while todo:
                v = todo.popleft()
                order.append(v)
                for w in g[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        todo.append(w)
                    if dist[w] == dist[v] + 1:
                        before[w].append(v)
                        paths[w] += paths[v]
        back = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                back[v] += paths[v] / paths[w] * (1 + back[w])
            if w != s:
                out[w] += back[w]
    n = len(g)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {v: x * scale for v, x in out.items()}


def eigenvector(g: dict, rounds: int = 200) -> dict:
    """Principal eigenvector of the weighted adjacency, by shifted power iteration."""
    names = sorted(g)
    at = {v: k for k, v in enumerate(names)}
    m = np.eye(len(names))
    for a in g:
        for b, w in g[a].items():
            m[at[a], at[b]] += w
    x = np.ones(len(names)) / max(1, len(names)) ** 0.5
    for _ in range(rounds):
        x = m @ x
        x /= np.linalg.norm(x)
    return dict(zip(names, x.tolist(), strict=True))


def louvain(g: dict, resolution: float = 1.0) -> dict:
    """Communities by modularity, nodes in sorted order so that results repeat; {node: number}, numbered by smallest node."""
    part = {v: v for v in g}
    graph = {v: dict(n) for v, n in g.items()}
    loops = dict.fromkeys(g, 0.0)
    total = sum(sum(n.values()) for n in g.values()) / 2
    while total > 0:
        com = {v: v for v in graph}
        degree = {v: sum(graph[v].values()) + 2 * loops[v] for v in graph}
        tot, moved = dict(degree), False
        for _ in range(50):
            changed = False
            for v in sorted(graph):
                links: dict = defaultdict(float)
                for u, w in graph[v].items():
                    links[com[u]] += w
                own = com[v]
                tot[own] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - resolution * tot[c] * degree[v] / (2 * total)  # noqa: B023, E731
                best = max([own, *sorted(links)], key=lambda c: (round(gain(c), 12), c == own))
                tot[best] += degree[v]
                if best != own:
                    com[v], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        part = {v: com[c] for v, c in part.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        inner: dict = defaultdict(float)
        for v in graph:
            inner[com[v]] += loops[v]
            for u, w in graph[v].items():
                if com[u] == com[v]:
                    inner[com[v]] += w / 2
                else:
                    merged[com[v]][com[u]] += w
        graph = {c: dict(merged[c]) for c in set(com.values())}
        loops = {c: inner[c] for c in graph}
    least: dict = {}
    for v in sorted(g):
        least.setdefault(part[v], len(least))
    return {v: least[part[v]] for v in g}


def independent_set(g: dict, order: list) -> list:
    """Maximal independent set, greedy in the given order."""
    out, gone = [], set()
    for v in order:
        if v not in gone:
            out.append(v)
            gone |= {v, *g.get(v, ())}
    return out


def max_flow(edges: list[tuple], source, sink) -> tuple[float, list]:
    """Dinic's algorithm on (src, dst, capacity) rows: value, and the edges of a minimum cut."""
    head: dict = defaultdict(list)
    to, cap = [], []
    for a, b, c in edges:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += [b, a]
        cap += [float(c), 0.0]
    value = 0.0
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            v = todo.popleft()
            for e in head[v]:
                if cap[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[v] + 1
                    todo.append(to[e])
        if sink not in level:
            cut = [(a, b) for k, (a, b, _) in enumerate(edges) if a in level and b not in level]
            return value, cut
        at = dict.fromkeys(level, 0)
        while True:  # one augmenting path after another, without recursion
            path, v = [], source
            while v != sink:
                while at.get(v, 0) < len(head[v]):
                    e = head[v][at[v]]
                    if cap[e] > 1e-12 and level.get(to[e], -1) == level[v] + 1:
                        break
                    at[v] += 1
                if at.get(v, 0) >= len(head[v]):
                    if not path:
                        break
                    e = path.pop()
                    v = to[e ^ 1]
                    at[v] += 1
                    continue
                path.append(head[v][at[v]])
                v = to[path[-1]]
            if v != sink:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            value += push
