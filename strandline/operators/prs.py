"""Polygenic scores. genotypes: (v, s, g), weights: (v, beta, p_value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import connected_components, path_betweenness
from strandline.operators.greedy import independent
from strandline.operators.lineage import written


def classical(genotypes: DataFrame, weights: DataFrame, samples: DataFrame, p_threshold: float = 5e-8) -> DataFrame:
    """(s, score, n_variants): sum of beta times dosage, missing and absent 0; every sample has a row."""
    w = weights.where(F.col("p_value") < p_threshold).select("v", "beta")
    sums = genotypes.join(w, "v").groupBy("s").agg(F.sum(F.col("beta") * F.coalesce("g", F.lit(0))).alias("score"), F.count("*").alias("n_variants"))
    return samples.select("s").join(sums, "s", "left").select("s", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"))


def prune(weights: DataFrame, ld: DataFrame, p_threshold: float = 5e-8, r2_threshold: float = 0.2, method: str = "centrality") -> DataFrame:
    """weights of one variant for each component of the linkage graph (highest betweenness, ties by p then v), or of a
    maximal independent set by ascending p. Both are found in rounds of joins; no component is a group."""
    w = written(weights.where(F.col("p_value") < p_threshold))
    ids = w.select("v")
    edges = ld.where(F.col("r2") >= r2_threshold).join(ids.select(F.col("v").alias("v1")), "v1").join(ids.select(F.col("v").alias("v2")), "v2").select(F.col("v1").alias("a"), F.col("v2").alias("b"))
    edges = written(edges)  # read by components and by paths
    if method != "centrality":
        return independent(w, edges, ["p_value"])
    tree = connected_components(edges)
    through = path_betweenness(edges).select(F.col("node").alias("v"), F.round("paths_through", 9).alias("through"))
    rows = w.join(tree, F.col("v") == F.col("node"), "left").join(through, "v", "left").withColumn("component", F.coalesce("component", "v"))
    best = rows.groupBy("component").agg(F.min_by("v", F.struct(-F.coalesce("through", F.lit(0.0)), F.col("p_value"), F.col("v"))).alias("v"))
    return w.join(best.select("v"), "v", "left_semi")


def by_pathway(genotypes: DataFrame, weights: DataFrame, variant_pathway: DataFrame, p_threshold: float = 1e-5) -> DataFrame:
    """(pathway, s, score) of samples with a carrier; a variant counts in each of its pathways once."""
    w = weights.where(F.col("p_value") < p_threshold).select("v", "beta").join(variant_pathway.select("v", "pathway").distinct(), "v")
    return genotypes.join(w, "v").groupBy("pathway", "s").agg(F.sum(F.col("beta") * F.coalesce("g", F.lit(0))).alias("score"))


def pathway_effects(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """(pathway, mean_cases, mean_controls, cohens_d, variance, variance_share); samples without a score count as 0."""
    n = samples.agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b")).first()
    a, b = float(n["a"]), float(n["b"])
    part = scores.join(samples.select("s", "is_case"), "s")
    case, x = F.col("is_case"), F.col("score")
    sums = part.groupBy("pathway").agg(F.sum(F.when(case, x).otherwise(0.0)).alias("sa"), F.sum(F.when(~case, x).otherwise(0.0)).alias("sb"), F.sum(F.when(case, x * x).otherwise(0.0)).alias("qa"), F.sum(F.when(~case, x * x).otherwise(0.0)).alias("qb"))
    va, vb = F.col("qa") / a - F.pow(F.col("sa") / a, 2), F.col("qb") / b - F.pow(F.col("sb") / b, 2)
    pooled = F.sqrt((a * va + b * vb) / (a + b))
    total = (F.col("qa") + F.col("qb")) / (a + b) - F.pow((F.col("sa") + F.col("sb")) / (a + b), 2)
    out = sums.select("pathway", (F.col("sa") / a).alias("mean_cases"), (F.col("sb") / b).alias("mean_controls"), F.when(pooled > 0, (F.col("sa") / a - F.col("sb") / b) / pooled).otherwise(0.0).alias("cohens_d"), total.alias("variance"))
    total = float(out.agg(F.sum("variance")).first()[0] or 0.0)
    return out.withColumn("variance_share", F.col("variance") / total if total > 0 else F.lit(None).cast("double"))


def auroc(scores: DataFrame) -> DataFrame:
    """(n_cases, n_controls, auroc) of (s, score, is_case) with mean ranks for ties.

    Counted by distinct score: cumulative sums need one row for each score, not for each sample."""
    by = scores.groupBy("score").agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("w", F.col("a") * (below + 0.5 * F.col("b"))).agg(F.sum("a").alias("n_cases"), F.sum("b").alias("n_controls"), (F.sum("w") / (F.sum("a") * F.sum("b"))).alias("auroc"))


def evaluate(scores: DataFrame) -> DataFrame:
    """n_cases, n_controls, auroc, nagelkerke_r2, decile_or (top tenth against the bottom tenth, halves added). Runs
    scores once."""
    scores = written(scores.select("score", "is_case"))  # every round reads them
    roc = auroc(scores)
    row = scores.agg(F.percentile("score", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).first()
    lo, hi = row["q"]
    x = (F.col("score") - F.lit(float(row["m"]))) / F.lit(float(row["d"]) or 1.0)
    rows = scores.select(x.alias("x"), F.col("is_case").cast("double").alias("y"), "score")
    beta = np.zeros(2)
    for _ in range(15):  # Newton over sums: five numbers a round
        p = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))
        w = p * (1 - p)
        s = rows.agg(F.sum(F.col("y") - p), F.sum((F.col("y") - p) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        h = np.array([[s[2], s[3]], [s[3], s[4]]])
        step = np.linalg.pinv(h) @ np.array([s[0], s[1]])
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))
    ll = F.sum(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    top, low = F.col("score") >= hi, F.col("score") <= lo
    out = rows.agg(F.count("*").alias("n"), F.avg("y").alias("r"), ll.alias("l1"), *[(F.count_if(c & (F.col("y") == y)) + 0.5).alias(n) for n, c, y in (("ta", top, 1), ("tb", top, 0), ("la", low, 1), ("lb", low, 0))])
    out = out.withColumn("l0", F.col("n") * (F.col("r") * F.log("r") + (1 - F.col("r")) * F.log(1 - F.col("r"))))
    cox = 1 - F.exp(2 / F.col("n") * (F.col("l0") - F.col("l1")))
    out = out.select((cox / (1 - F.exp(2 / F.col("n") * F.col("l0")))).alias("nagelkerke_r2"), (F.col("ta") * F.col("lb") / (F.col("tb") * F.col("la"))).alias("decile_or"))
    r = out.first()  # one row
    return roc.withColumns({"nagelkerke_r2": F.lit(r["nagelkerke_r2"]), "decile_or": F.lit(r["decile_or"])})
