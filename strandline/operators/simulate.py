"""Phenotype simulators over genotypes (v, s, g). Noise has variance Vg (1/h2 - 1); seeds are hashed with the sample."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.lineage import md5_number


def select_by_frequency(variants: DataFrame, af_min: float, af_max: float, n: int, min_spacing: int = 100_000, seed: int = 42) -> DataFrame:
    """n variants (v, chr, pos, af) in the frequency range, in hash order, at least min_spacing apart on a chromosome."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values("h").itertuples():
            if all(abs(r.pos - k.pos) >= min_spacing for k in kept):
                kept.append(r)
        return pdf.loc[[k.Index for k in kept]]

    rows = variants.where(F.col("af").between(af_min, af_max)).select("v", "chr", "pos", "af", F.xxhash64("v", F.lit(seed)).alias("h"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("chr").applyInPandas(run, schema).orderBy("h").limit(n).drop("h")


def gaussian(seed: int):
    """A standard normal number of each sample, the same however rows are partitioned (Box-Muller on hashes)."""
    u = lambda k: (md5_number(F.col("s"), F.lit(seed), F.lit(k)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def with_noise(value: DataFrame, h2: float, seed: int) -> DataFrame:
    """(s, genetic_value, y) of (s, x). The variance of x is worked out first."""
    var = float(value.agg(F.var_pop("x")).first()[0] or 0.0)
    scale = math.sqrt(max(var, 1e-12) * (1 / h2 - 1))
    return value.select("s", F.col("x").alias("genetic_value"), (F.col("x") + scale * gaussian(seed)).alias("y"))


def dense_dosages(genotypes: DataFrame, samples: DataFrame, chosen: list) -> DataFrame:
    """(s, g0, g1, ...): mean-centred dosages of the chosen variants; missing ones are at the mean. Means come first."""
    n = samples.count()
    rows = genotypes.where(F.col("v").isin(*chosen)).join(samples.select("s"), "s", "left_semi")
    sums = {r["v"]: r for r in rows.groupBy("v").agg(F.sum("g").alias("g"), F.count_if(F.col("g").isNull()).alias("m")).collect()}  # one for each chosen variant
    mean = [float(sums[v]["g"] or 0) / max(n - sums[v]["m"], 1) if v in sums else 0.0 for v in chosen]
    own = [F.max(F.when(F.col("v") == v, F.coalesce(F.col("g").cast("double"), F.lit(mean[k])))).alias(f"g{k}") for k, v in enumerate(chosen)]
    wide = samples.select("s").join(rows.groupBy("s").agg(*own), "s", "left")
    return wide.select("s", *[(F.coalesce(f"g{k}", F.lit(0.0)) - mean[k]).alias(f"g{k}") for k in range(len(chosen))])


def pure_interaction(genotypes, samples, pairs: list[tuple], beta: float = 1.5, h2: float = 0.3, seed: int = 42) -> DataFrame:
    """y from products of centred pairs alone."""
    flat = [v for p in pairs for v in p]
    d = dense_dosages(genotypes, samples, flat)
    x = sum((beta * F.col(f"g{2 * k}") * F.col(f"g{2 * k + 1}") for k in range(len(pairs))), F.lit(0.0))
    return with_noise(d.select("s", x.alias("x")), h2, seed)


def additive_interaction(genotypes, samples, pairs: list[tuple], beta_marginal: float = 0.3, beta: float = 0.5, h2: float = 0.3, seed: int = 42) -> DataFrame:
    """Marginal effects of every member, and products."""
    flat = [v for p in pairs for v in p]
    d = dense_dosages(genotypes, samples, flat)
    x = sum((beta_marginal * F.col(f"g{k}") for k in range(len(flat))), F.lit(0.0)) + sum((beta * F.col(f"g{2 * k}") * F.col(f"g{2 * k + 1}") for k in range(len(pairs))), F.lit(0.0))
    return with_noise(d.select("s", x.alias("x")), h2, seed)


def synthetic_lethality(genotypes, samples, pair: tuple, beta_marginal: float = 0.3, h2: float = 0.2, seed: int = 42) -> DataFrame:
    """Marginal effects; samples that are homozygous for both have no trait (null)."""
    d = dense_dosages(genotypes, samples, list(pair))
    both = genotypes.where(F.col("v").isin(*pair) & (F.col("g") == 2)).groupBy("s").agg(F.count_distinct("v").alias("k")).where("k = 2").select("s", F.lit(True).alias("dead"))
    out = with_noise(d.select("s", (beta_marginal * (F.col("g0") + F.col("g1"))).alias("x")), h2, seed)
    return out.join(both, "s", "left").select("s", "genetic_value", F.when(F.col("dead").isNull(), F.col("y")).alias("y"))


def multiway(genotypes, samples, chosen: list, beta: float = 1.0, h2: float = 0.2, seed: int = 42) -> DataFrame:
    """The product of all chosen centred dosages."""
    d, x = dense_dosages(genotypes, samples, chosen), F.lit(beta)
    for k in range(len(chosen)):
        x = x * F.col(f"g{k}")
    return with_noise(d.select("s", x.alias("x")), h2, seed)


def causal(genotypes, samples, effects: dict, h2: float = 0.1, seed: int = 42) -> DataFrame:
    """Additive effects {v: beta}: single, several independent, or many pathway loci."""
    d = dense_dosages(genotypes, samples, list(effects))
    x = sum((b * F.col(f"g{k}") for k, b in enumerate(effects.values())), F.lit(0.0))
    return with_noise(d.select("s", x.alias("x")), h2, seed)


def near_center(variants: DataFrame, chr, center: int, window: int, af_min: float = 0.05, af_max: float = 0.5) -> DataFrame:
    """Candidates of a locus, nearest to its center first."""
    return variants.where((F.col("chr") == chr) & F.col("pos").between(center - window // 2, center + window // 2) & F.col("af").between(af_min, af_max)).orderBy(F.abs(F.col("pos") - center), "v")


def null_loci(variants: DataFrame, variant_gene: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Variants of no gene (anti join), n of them in hash order."""
    return variants.join(variant_gene.select("v"), "v", "left_anti").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(n)


def pathways_with_genes(gene_pathway: DataFrame, k: int, limit: int = 10) -> DataFrame:
    """(pathway, n_genes, genes) with k genes or more, largest first."""
    return gene_pathway.groupBy("pathway").agg(F.count_distinct("gene").alias("n_genes"), F.array_sort(F.collect_set("gene")).alias("genes")).where(F.col("n_genes") >= k).orderBy(F.desc("n_genes"), "pathway").limit(limit)


def no_path_null(samples: DataFrame, z: DataFrame, lam: float, seed: int = 42) -> DataFrame:
    """y = u + e with u in the span of Z (s, z) alone and var(u) = lam / (1 - lam)."""
    rows = samples.select("s").join(z, "s")
    m = rows.agg(F.avg("z").alias("a"), F.stddev_pop("z").alias("d")).first()
    std = (F.col("z") - float(m["a"] or 0.0)) / (float(m["d"] or 0.0) or 1.0)
    return rows.select("s", (math.sqrt(lam / (1 - lam)) * std + gaussian(seed)).alias("y"))
