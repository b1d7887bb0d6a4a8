"""Bundles of operators: each returns its tables by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import met, multivariate, prs, structure


def spectrum_of(genotypes: DataFrame, samples: DataFrame, af_threshold: float, k: int, sets: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, eigenvalues and eigenvectors of the similarity graph of variants, or of sets of them."""
    n = samples.count()
    sim = structure.similarity(genotypes, n, af_threshold) if sets is None else structure.set_similarity(genotypes, sets, n, af_threshold)
    ids, m = structure.dense(sim, samples)
    values, vectors = structure.laplacian_spectrum(m, k)
    return ids, values, vectors


def trait_on(ids: np.ndarray, samples: DataFrame, column: str = "y") -> np.ndarray:
    """The trait in the order of ids; missing values at the mean. Keyed by sample id, never by position."""
    y = samples.select("s", column).toPandas().set_index("s")[column].reindex(ids).to_numpy(float)
    return np.where(np.isnan(y), np.nanmean(y), y)


def heritability(genotypes: DataFrame, samples: DataFrame, variant_gene: DataFrame, gene_pathway: DataFrame, af_threshold: float = 0.01, k: int = 20) -> dict:
    """Spectral estimates at three scales and their differences, and the conductance estimate's table."""
    genes = variant_gene.select("v", F.col("gene").cast("string").alias("set"))
    paths = variant_gene.join(gene_pathway, "gene").select("v", F.col("pathway").alias("set")).distinct()
    h2 = []
    for sets in (None, genes, paths):
        ids, values, vectors = spectrum_of(genotypes, samples, af_threshold, k, sets)
        h2.append(structure.spectral_heritability(values, vectors, trait_on(ids, samples))["h2"])
    return {"h2": dict(zip(("variant", "gene", "pathway"), h2, strict=True)), "shares": structure.multiresolution(*h2), "conductance": structure.conductance_heritability(genotypes, samples, af_threshold, 50)}


def bivariate(genotypes: DataFrame, samples: DataFrame, traits: list[str], af_threshold: float = 0.01, k: int = 20) -> dict:
    """Covariance in the low-frequency subspace of two traits, and the G matrix; samples has a column for each trait."""
    ids, values, vectors = spectrum_of(genotypes, samples, af_threshold, k)
    y = {t: trait_on(ids, samples, t) for t in traits}
    names, g, r = multivariate.g_matrix(values, vectors, y)
    return {"pair": multivariate.spectral_covariance(values, vectors, y[traits[0]], y[traits[1]]), "names": names, "g": g, "r_g": r}


def multiresolution_correlation(genotypes: DataFrame, samples: DataFrame, traits: tuple[str, str], variant_gene: DataFrame, gene_pathway: DataFrame, af_threshold: float = 0.01, k: int = 20) -> dict[str, float]:
    """r_g of two traits at the scales of variants, genes and pathways."""
    genes = variant_gene.select("v", F.col("gene").cast("string").alias("set"))
    paths = variant_gene.join(gene_pathway, "gene").select("v", F.col("pathway").alias("set")).distinct()
    out = {}
    for name, sets in (("variant", None), ("gene", genes), ("pathway", paths)):
        ids, values, vectors = spectrum_of(genotypes, samples, af_threshold, k, sets)
        out[name] = multivariate.spectral_covariance(values, vectors, *(trait_on(ids, samples, t) for t in traits))["r_g"]
    return out


def spectral_components(genotypes: DataFrame, samples: DataFrame, af_threshold: float = 0.05, k: int = 20) -> DataFrame:
    """(s, name, value): eigenvectors of the rare-variant graph as covariates spectral_pc_1.."""
    import pandas as pd

    ids, _, vectors = spectrum_of(genotypes, samples, af_threshold, k)
    rows = pd.DataFrame({"s": np.repeat(ids, vectors.shape[1]), "name": [f"spectral_pc_{c + 1}" for c in range(vectors.shape[1])] * len(ids), "value": vectors.ravel()})
    return samples.sparkSession.createDataFrame(rows)


def trial(obs: DataFrame) -> dict[str, DataFrame]:
    return {"gxe": met.gxe(obs), "similarity": met.environment_similarity(obs), "mega": met.mega_environments(obs), **met.design(obs)}


def scores(genotypes: DataFrame, samples: DataFrame, weights: DataFrame, ld: DataFrame, variant_pathway: DataFrame, p_threshold: float = 5e-8) -> dict[str, DataFrame]:
    """Evaluations of the classical and the pruned score at p_threshold, and effects of the pathway scores at 1e-5."""
    out = {}
    for name, w in (("classical", weights), ("pruned", prs.prune(weights, ld, p_threshold))):
        s = prs.classical(genotypes, w, samples, p_threshold).join(samples.select("s", "is_case"), "s")
        out[name] = prs.auroc(s)
    out["pathway"] = prs.pathway_effects(prs.by_pathway(genotypes, weights, variant_pathway), samples)
    return out
