"""Linkage graphs of loci and their centralities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import adjacency, betweenness, eigenvector


def ld_graph(ld: DataFrame, r2_threshold: float = 0.3) -> DataFrame:
    return ld.where(F.col("r2") >= r2_threshold)


def centrality(ld: DataFrame, method: str = "betweenness", top_k: int | None = 10, groups: str = "locus") -> DataFrame:
    """(locus, v, score, rank) of ld (locus, v1, v2, r2): betweenness (r2 as length), degree (sum of r2), pagerank,
    eigenvector; one group for each locus, ties by v."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = adjacency(pdf[["v1", "v2", "r2"]].itertuples(index=False))
        if method == "betweenness":
            score = betweenness(g, weighted=True)
        elif method == "degree":
            score = {v: sum(n.values()) for v, n in g.items()}
        elif method == "eigenvector":
            score = eigenvector(g)
        else:
            score = dict.fromkeys(g, 1.0 / len(g))
            total = {v: sum(n.values()) for v, n in g.items()}
            for _ in range(100):
                score = {v: 0.15 / len(g) + 0.85 * sum(score[u] * w / total[u] for u, w in g[v].items()) for v in g}
        rows = sorted(score.items(), key=lambda e: (-e[1], e[0]))[: top_k or len(score)]
        return pd.DataFrame({groups: pdf[groups].iloc[0], "v": [v for v, _ in rows], "score": [s for _, s in rows], "rank": range(1, len(rows) + 1)})

    if method not in ("betweenness", "degree", "pagerank", "eigenvector"):
        raise ValueError(method)
    kind = ld.schema[groups].dataType.simpleString()
    return ld.select(groups, "v1", "v2", "r2").groupBy(groups).applyInPandas(run, f"{groups} {kind}, v long, score double, rank int")
