"""Random walks with restart on variant-gene graphs, and weighted gene-gene substrates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut
from strandline.operators.graph import symmetric


def bipartite(variant_gene: DataFrame) -> DataFrame:
    """(v, gene, w) with weight 1."""
    return variant_gene.select("v", "gene").distinct().withColumn("w", F.lit(1.0))


def transition(edges: DataFrame, substrate: DataFrame | None = None) -> DataFrame:
    """(i, j, p): variant -> gene [-> gene by the row-normalised substrate (a, b, w)] -> variant."""
    vg = edges.select("v", "gene", (F.col("w") / F.sum("w").over(Window.partitionBy("v"))).alias("p"))
    gv = edges.select("gene", F.col("v").alias("j"), (F.col("w") / F.sum("w").over(Window.partitionBy("gene"))).alias("q"))
    if substrate is not None:
        gg = substrate.select(F.col("a").alias("gene"), F.col("b").alias("g2"), F.col("w").alias("r"))
        vg = vg.join(gg, "gene").select("v", F.col("g2").alias("gene"), (F.col("p") * F.col("r")).alias("p"))
    return vg.join(gv, "gene").groupBy(F.col("v").alias("i"), "j").agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def factors(edges: DataFrame) -> list[DataFrame]:
    """transition() as two tables (i, j, p), gene from variant and variant from gene: a round over both has as many rows as
    there are edges, where their product has a row for every two variants of a gene."""
    gv = edges.select(F.col("gene").alias("i"), F.col("v").alias("j"), (F.col("w") / F.sum("w").over(Window.partitionBy("gene"))).alias("p"))
    return [gv, edges.select(F.col("v").alias("i"), F.col("gene").alias("j"), (F.col("w") / F.sum("w").over(Window.partitionBy("v"))).alias("p"))]


def lumps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, at, n), (at, gene, w, n): variants with the same genes and weights are one lump, named by its least variant (at), of n
    variants. A walk cannot tell them apart, so all it says of two variants depends on their lumps and on being the seed."""
    own = edges.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("gene", "w"))).alias("like"))
    named = own.groupBy("like").agg(F.min("v").alias("at"), F.count("*").alias("n"))
    members = cut(own.join(named, "like").select("v", "at", "n"))
    return members, edges.join(members.where(F.col("v") == F.col("at")), "v").select("at", "gene", "w", "n")


def lump_factors(edges: DataFrame) -> list[DataFrame]:
    """factors() on lumps (at, gene, w, n): a lump's entry is the sum of its variants'."""
    gv = edges.select(F.col("gene").alias("i"), F.col("at").alias("j"), (F.col("w") / F.sum(F.col("n") * F.col("w")).over(Window.partitionBy("gene"))).alias("p"))
    return [gv, edges.select(F.col("at").alias("i"), F.col("gene").alias("j"), (F.col("n") * F.col("w") / F.sum("w").over(Window.partitionBy("at"))).alias("p"))]


def gene_transition(edges: DataFrame) -> DataFrame:
    """(i, j, p): gene -> variant -> gene, the walk's matrix on the gene side."""
    gv = edges.select("v", F.col("gene").alias("i"), (F.col("w") / F.sum("w").over(Window.partitionBy("gene"))).alias("p"))
    vg = edges.select("v", F.col("gene").alias("j"), (F.col("w") / F.sum("w").over(Window.partitionBy("v"))).alias("q"))
    return gv.join(vg, "v").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def gene_pair_scores(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, top_k: int = 200, rounds: int = 30) -> DataFrame:
    """(a, b, score): mutual walk scores of seed genes (gene), highest first."""
    walks = walk(gene_transition(edges), seeds.select(F.col("gene").alias("v")), alpha, rounds)
    return mutual_pairs(walks, top_k).select(F.col("v1").alias("a"), F.col("v2").alias("b"), "score")


def walk(step: DataFrame | list[DataFrame], seeds: DataFrame, alpha: float = 0.15, rounds: int = 50, tol: float = 1e-9, every: int = 10) -> DataFrame:
    """(seed, v, p): all seeds at once. p <- (1 - alpha) M p + alpha e with the row-stochastic M on the left, until no entry
    moves by tol; normalised to sum 1. step: M (i, j, p), or factors of it, the one that is applied first coming first.
    seeds: (v), or (v, at) with the lump of each: seeds of a lump walk once, under its name, and column own has what the last
    restart gave to the seed alone. Lineage is checkpointed every few rounds."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    lumped = "at" in seeds.columns
    at = seeds.select(F.col("at").alias("v")).distinct() if lumped else seeds
    start = at.select(F.col("v").alias("seed"), F.col("v"), F.lit(1.0).alias("p"))
    now, steps = start, [cut(x) for x in (step if isinstance(step, list) else [step])]
    for k in range(rounds):
        for n, x in enumerate(steps):
            keep = 1 - alpha if n == len(steps) - 1 else 1.0
            moved = x.join((now if n == 0 else moved).withColumnRenamed("v", "j").withColumnRenamed("p", "x"), "j").select("seed", F.col("i").alias("v"), (keep * F.col("p") * F.col("x")).alias("p"))
            if n < len(steps) - 1:
                moved = moved.groupBy("seed", "v").agg(F.sum("p").alias("p"))
        now = moved.union(start.select("seed", "v", F.lit(alpha).alias("p"))).groupBy("seed", "v").agg(F.sum("p").alias("p"))
        if k % every == every - 1:
            was, now = (None if k < every else held), cut(now)  # noqa: F821
            if was is not None:
                gap = now.join(was.withColumnRenamed("p", "o"), ["seed", "v"], "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))))).first()[0]
                if gap is None or gap < tol:
                    break
            held = now
    total = F.sum("p").over(Window.partitionBy("seed"))
    if lumped:
        return now.select("seed", "v", (F.col("p") / total).alias("p"), (F.lit(alpha if rounds else 1.0) / total).alias("own"))
    return now.withColumn("p", F.col("p") / total)


def mutual_pairs(walks: DataFrame, top_k: int = 1000) -> DataFrame:
    """(v1, v2, score): p_i(j) p_j(i) > 0 of seeds i < j, highest first; equal to 12 places, by v1 and v2."""
    a = walks.select(F.col("seed").alias("v1"), F.col("v").alias("v2"), F.col("p").alias("x"))
    b = walks.select(F.col("v").alias("v1"), F.col("seed").alias("v2"), F.col("p").alias("y"))
    out = a.where("v1 < v2").join(b, ["v1", "v2"]).select("v1", "v2", (F.col("x") * F.col("y")).alias("score"))
    return out.where("score > 0").orderBy(F.desc(F.round("score", 12)), "v1", "v2").limit(top_k)


def mutual_pairs_of_lumps(walks: DataFrame, members: DataFrame, top_k: int = 1000) -> DataFrame:
    """mutual_pairs() of all variants from the walks of their lumps; members: (v, at, n).

    All pairs of two lumps have one score. Only the first top_k pairs of lumps, by score and then by their first pair of
    variants, can hold one of the first top_k pairs; of those only pairs are made that fewer than top_k others of the same two
    lumps precede: the a-th variant of one and the b-th of the other come after all a * b pairs of those before them."""
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("at").orderBy("v"))).where(F.col("k") <= 2 * top_k + 2)
    size = members.groupBy("at").agg(F.first("n").alias("n"))
    least = size.join(ranked.where("k = 1").select("at", F.col("v").alias("first")), "at").join(ranked.where("k = 2").select("at", F.col("v").alias("second")), "at", "left")
    to = walks.join(size.select(F.col("at").alias("v"), "n"), "v").withColumn("p", (F.col("p") - F.when(F.col("seed") == F.col("v"), F.col("own")).otherwise(0.0)) / F.col("n"))
    a = to.select(F.col("seed").alias("c1"), F.col("v").alias("c2"), F.col("p").alias("x"))
    b = to.select(F.col("v").alias("c1"), F.col("seed").alias("c2"), F.col("p").alias("y"))
    both = a.where("c1 <= c2").join(b, ["c1", "c2"]).select("c1", "c2", (F.col("x") * F.col("y")).alias("score")).where("score > 0")
    both = both.join(least.select(F.col("at").alias("c1"), F.col("first").alias("f1"), "second"), "c1").join(least.select(F.col("at").alias("c2"), F.col("first").alias("f2")), "c2")
    both = both.where("c1 <> c2 OR second IS NOT NULL")
    same = F.col("c1") == F.col("c2")
    best = both.orderBy(F.desc(F.round("score", 12)), F.least("f1", "f2"), F.when(same, F.col("second")).otherwise(F.greatest("f1", "f2"))).limit(top_k)
    for k in ("1", "2"):
        best = best.join(ranked.select(F.col("at").alias(f"c{k}"), F.col("v").alias(f"x{k}"), F.col("k").alias(f"k{k}")), f"c{k}")
    out = best.where((F.col("k1") * F.col("k2") <= 2 * top_k + 2) & ((F.col("c1") != F.col("c2")) | (F.col("k1") < F.col("k2"))))
    out = out.select(F.least("x1", "x2").alias("v1"), F.greatest("x1", "x2").alias("v2"), "score")
    return out.orderBy(F.desc(F.round("score", 12)), "v1", "v2").limit(top_k)


def hub_deflated(walks: DataFrame, degrees: DataFrame, top_k: int = 1000) -> DataFrame:
    """(v1, v2, score): (p_i(j) + p_j(i)) / (d_i d_j). degrees: (v, d)."""
    a = walks.select(F.least("seed", "v").alias("v1"), F.greatest("seed", "v").alias("v2"), "p").where("v1 < v2").groupBy("v1", "v2").agg(F.sum("p").alias("p"))
    for k in ("1", "2"):
        a = a.join(degrees.select(F.col("v").alias(f"v{k}"), F.col("d").alias(f"d{k}")), f"v{k}")
    return a.select("v1", "v2", (F.col("p") / (F.col("d1") * F.col("d2"))).alias("score")).orderBy(F.desc("score"), "v1", "v2").limit(top_k)


def triplets(pairs: DataFrame, top_k: int = 200) -> DataFrame:
    """(v1, v2, v3, score): triangles of pairs, product of their three scores. pairs must hold v1 < v2."""
    ab = pairs.select("v1", "v2", F.col("score").alias("x"))
    bc = pairs.select(F.col("v1").alias("v2"), F.col("v2").alias("v3"), F.col("score").alias("y"))
    ac = pairs.select("v1", F.col("v2").alias("v3"), F.col("score").alias("z"))
    out = ab.join(bc, "v2").join(ac, ["v1", "v3"])
    return out.select("v1", "v2", "v3", (F.col("x") * F.col("y") * F.col("z")).alias("score")).orderBy(F.desc("score"), "v1", "v2", "v3").limit(top_k)


def expand_gene_pairs(gene_pairs: DataFrame, variant_gene: DataFrame, max_per_gene: int = 50) -> DataFrame:
    """(v1, v2, score): members of each gene pair (a, b, score), at most max_per_gene by hash; the best score of a pair."""
    rank = F.row_number().over(Window.partitionBy("gene").orderBy(F.xxhash64("v"), "v"))
    few = variant_gene.select("v", "gene").distinct().withColumn("k", rank).where(F.col("k") <= max_per_gene)
    out = gene_pairs.join(few.select(F.col("gene").alias("a"), F.col("v").alias("x")), "a").join(few.select(F.col("gene").alias("b"), F.col("v").alias("y")), "b").where("x <> y")
    return out.groupBy(F.least("x", "y").alias("v1"), F.greatest("x", "y").alias("v2")).agg(F.max("score").alias("score"))


def clean_edges(rows: DataFrame) -> DataFrame:
    """(a, b, source, w), a < b: the largest finite weight of each source; self pairs go."""
    ok = rows.where((F.col("a") != F.col("b")) & F.col("w").isNotNull() & ~F.isnan("w") & (F.abs("w") != F.lit(float("inf"))))
    return ok.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "source").agg(F.max("w").alias("w"))


def scaled_scores(rows: DataFrame, columns: list[str], scale: float) -> DataFrame:
    """Adds w: the largest absolute value of the columns over scale, at most 1."""
    top = F.greatest(*[F.abs(c) for c in columns]) if len(columns) > 1 else F.abs(columns[0])
    return rows.withColumn("w", F.least(top / scale, F.lit(1.0)))


def gene_matrix(edges: DataFrame, genes: DataFrame, pool: str = "max", source_weights: dict[str, float] | None = None, self_loops: bool = True) -> DataFrame:
    """(a, b, w) in both directions over genes: sources pooled by max, sum or noisy_or, then self loops of 1."""
    w = F.col("w")
    if source_weights:
        w = w * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in source_weights.items() for x in (k, float(v))]), F.col("source")), F.lit(1.0))
    if pool == "noisy_or":
        agg = F.when(F.max("x") >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(F.col("x") < 1, F.log1p(-F.col("x"))).otherwise(0.0))))
    else:
        agg = {"max": F.max("x"), "sum": F.sum("x")}[pool]
    ids = genes.select("gene").distinct()
    some = edges.join(ids.withColumnRenamed("gene", "a"), "a", "left_semi").join(ids.withColumnRenamed("gene", "b"), "b", "left_semi")
    out = symmetric(some.withColumn("x", w).groupBy("a", "b").agg(agg.alias("w")), "a", "b", "w")
    return out.union(ids.select(F.col("gene").alias("a"), F.col("gene").alias("b"), F.lit(1.0))) if self_loops else out


def row_normalise(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy("a")), F.lit(1e-12)))


def diagnostics(edges: DataFrame) -> DataFrame:
    """source, n, lo, hi, median, mean"""
    return edges.groupBy("source").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile("w", 0.5).alias("median"), F.avg("w").alias("mean"))


def inject_partners(annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """annotations (v, genes, pathways, ppi) with the partners that edges (a, b) give any of the genes."""
    both = symmetric(edges)
    more = annotations.select("v", F.explode("genes").alias("a")).join(both, "a").groupBy("v").agg(F.collect_set("b").alias("_m"))
    out = annotations.join(more, "v", "left")
    return out.withColumn("ppi", F.when(F.col("_m").isNull(), F.col("ppi")).otherwise(F.array_sort(F.array_union("ppi", "_m")))).drop("_m")


def dense_walk(m: np.ndarray, seed: int, alpha: float = 0.15, rounds: int = 50, tol: float = 1e-6) -> np.ndarray:
    """One seed on a dense matrix: what walk() does, for tests and small groups."""
    e = np.zeros(len(m))
    e[seed] = 1.0
    p = e
    for _ in range(rounds):
        q = (1 - alpha) * (m @ p) + alpha * e
        p, gap = q, np.abs(q - p).max()
        if gap < tol:
            break
    return p / p.sum()


