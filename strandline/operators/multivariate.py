"""Several traits: pleiotropy, flow covariance, spectral covariance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete_traits(phenotypes: DataFrame, traits: list[str]) -> DataFrame:
    """(s, one column for each trait) of the samples that have all."""
    wide = phenotypes.where(F.col("trait").isin(traits)).groupBy(F.col("sample_id").alias("s")).pivot("trait", traits).agg(F.first("num"))
    return wide.dropna(subset=traits)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 without variance."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"d_{c}"]) if row[f"d_{c}"] else F.lit(0.0) for c in columns})


def pleiotropic_genes(run1: DataFrame, run2: DataFrame, variant_gene: DataFrame, p_threshold: float = 5e-8) -> DataFrame:
    """(gene, n1, n2, n_shared, kind): genes with hits in both runs; biological if they share a variant, else mediated.

    run: (v, p_value)."""
    hits = lambda r, n: r.where(F.col("p_value") < p_threshold).join(variant_gene.select("v", "gene").distinct(), "v").groupBy("gene").agg(F.collect_set("v").alias(n))
    both = hits(run1, "a").join(hits(run2, "b"), "gene")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("gene", F.size("a").alias("n1"), F.size("b").alias("n2"), shared.alias("n_shared"), F.when(shared > 0, "biological").otherwise("mediated").alias("kind"))


def pleiotropy_score(runs: DataFrame, variant_gene: DataFrame, p_threshold: float = 5e-8) -> DataFrame:
    """(gene, breadth, mean_log10p, overlap, psi, rank) of genes with hits in two runs or more. runs: (run_id, v, p_value).

    psi = breadth * mean of the runs' best -log10 p * (1 + mean over run pairs of shared over joint hit variants)."""
    hits = runs.where(F.col("p_value") < p_threshold).join(variant_gene.select("v", "gene").distinct(), "v")
    per = hits.groupBy("gene", "run_id").agg(F.max(-F.log10(F.greatest("p_value", F.lit(1e-300)))).alias("best"), F.collect_set("v").alias("vs"))
    a, b = per.select("gene", F.col("run_id").alias("r1"), F.col("vs").alias("v1")), per.select("gene", F.col("run_id").alias("r2"), F.col("vs").alias("v2"))
    pairs = a.join(b, "gene").where("r1 < r2").groupBy("gene").agg(F.avg(F.size(F.array_intersect("v1", "v2")) / F.size(F.array_union("v1", "v2"))).alias("overlap"))
    out = per.groupBy("gene").agg(F.count("*").alias("breadth"), F.avg("best").alias("mean_log10p")).where("breadth >= 2").join(pairs, "gene")
    out = out.withColumn("psi", F.col("breadth") * F.col("mean_log10p") * (1 + F.col("overlap")))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("psi"), "gene")))  # a row for each gene


def flow_covariance(one: DataFrame, other: DataFrame) -> DataFrame:
    """(n_pathways, cosine, shared_flow) of flows (pathway, flow): full outer join, missing flows are 0."""
    both = one.select("pathway", F.col("flow").alias("a")).join(other.select("pathway", F.col("flow").alias("b")), "pathway", "full").select("pathway", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    norm = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    total = F.sum(F.greatest("a", "b"))
    return both.agg(F.count("*").alias("n_pathways"), F.when(norm > 0, F.sum(F.col("a") * F.col("b")) / norm).otherwise(0.0).alias("cosine"), F.when(total > 0, F.sum(F.least("a", "b")) / total).otherwise(0.0).alias("shared_flow"))


def spectrum(vectors: np.ndarray, *traits: np.ndarray) -> list[np.ndarray]:
    """Coefficients of standardised traits on eigenvectors (columns)."""
    scale = lambda x: (x - x.mean()) / (x.std() or 1.0)
    return [vectors.T @ scale(np.asarray(t, float)) for t in traits]


def spectral_covariance(values: np.ndarray, vectors: np.ndarray, one: np.ndarray, other: np.ndarray) -> dict[str, float]:
    """Covariance, variances and correlation of two traits in the low-frequency subspace, cut at the largest eigengap."""
    order = np.argsort(values)
    gaps = np.diff(values[order])
    cut = int(np.argmax(gaps)) + 1 if len(gaps) else 1
    a, b = spectrum(vectors[:, order], one, other)
    n = len(one)
    cov, va, vb = (float((x[:cut] * y[:cut]).sum() / n) for x, y in ((a, b), (a, a), (b, b)))
    r = cov / (va * vb) ** 0.5 if va > 0 and vb > 0 else 0.0
    return {"cut": cut, "covariance": cov, "h2_1": va, "h2_2": vb, "r_g": float(np.clip(r, -1, 1))}


def g_matrix(values: np.ndarray, vectors: np.ndarray, traits: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, G and r_G over all pairs."""
    names = sorted(traits)
    g = np.array([[spectral_covariance(values, vectors, traits[a], traits[b])["covariance"] for b in names] for a in names])
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return names, g, np.clip(g / np.outer(d, d), -1, 1)


def coherence(spectra: DataFrame) -> DataFrame:
    """Adds coherence: (c1 c2)^2 / (c1^2 c2^2) of each component, 1 wherever the product is not 0, and sign agreement."""
    product = F.col("c1") * F.col("c2")
    return spectra.withColumns({"coherence": F.when(product * product > 1e-20, 1.0).otherwise(0.0), "agreement": F.signum(product)})
