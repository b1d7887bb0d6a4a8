"""Summary-statistics algebra. Rows: (chr, pos, ref, alt, beta, se, pval)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline.functions.special import normal_isf, normal_two_sided
from strandline.operators.greedy import apart
from strandline.operators.intervals import interval_join

KEY = ["chr", "pos", "ref", "alt"]


@pandas_udf(T.DoubleType())
def z_from_p(p: pd.Series) -> pd.Series:
    """|z| of a two-sided p; 0 for null, at most that of 1e-300."""
    q = p.astype(float).fillna(1.0).clip(1e-300, 1.0).to_numpy()
    return pd.Series(abs(normal_isf(q / 2)))


def significant(df: DataFrame, p_threshold: float = 5e-8) -> DataFrame:
    return df.where(F.col("pval") < p_threshold)


def with_z(df: DataFrame) -> DataFrame:
    """z = beta / se, else the sign of beta times the quantile of p, else 0."""
    return df.withColumn("z", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).when(F.col("pval").isNotNull() & F.col("beta").isNotNull(), F.signum("beta") * z_from_p("pval")).otherwise(0.0))


def gene_test(df: DataFrame, genes: DataFrame, window: int = 10_000) -> DataFrame:
    """gene, n_variants, mean_chi2, stat (sum of z^2 over the root of n, not centred), p_value (normal, scale root 2)."""
    hit = interval_join(with_z(df).select("chr", "pos", "z"), genes, window)
    out = hit.groupBy("gene").agg(F.count("*").alias("n_variants"), F.avg(F.col("z") * F.col("z")).alias("mean_chi2"), F.sum(F.col("z") * F.col("z")).alias("_s"))
    out = out.withColumn("stat", F.col("_s") / F.sqrt("n_variants")).drop("_s")
    tail = normal_two_sided(F.col("stat") / math.sqrt(2.0)) / 2
    return out.withColumn("p_value", F.when(F.col("stat") >= 0, tail).otherwise(1 - tail))


def merge_traits(traits: dict[str, DataFrame], key: list[str] = KEY) -> DataFrame:
    """Inner join on the variant key; one z column for each trait."""
    out = None
    for name, df in traits.items():
        one = with_z(df).groupBy(*key).agg(F.max_by("z", F.abs("z")).alias(f"z_{name}"))
        out = one if out is None else out.join(one, key)
    return out


def genetic_correlation(traits: dict[str, DataFrame], min_shared: int = 100, key: list[str] = KEY) -> DataFrame:
    """(trait1, trait2, n, r): correlation of z over shared variants; null below min_shared. One pass over the join."""
    names = sorted(traits)
    both = merge_traits(traits, key)
    sums = both.agg(F.count("*").alias("n"), *[F.corr(f"z_{a}", f"z_{b}").alias(f"r_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j])
    rows = F.array(*[F.struct(F.lit(a).alias("trait1"), F.lit(b).alias("trait2"), F.col("n"), F.when(F.col("n") >= min_shared, F.col(f"r_{i}_{j}")).alias("r")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j])
    return sums.select(F.inline(rows))


def pleiotropy(traits: dict[str, DataFrame], p_threshold: float = 5e-8, key: list[str] = KEY) -> DataFrame:
    """Variants with p < threshold in two traits or more: key, traits, n_traits."""
    all_ = None
    for name, df in sorted(traits.items()):
        one = significant(df, p_threshold).select(*key, F.lit(name).alias("trait"))
        all_ = one if all_ is None else all_.union(one)
    out = all_.groupBy(*key).agg(F.array_sort(F.collect_set("trait")).alias("traits"))
    return out.withColumn("n_traits", F.size("traits")).where("n_traits >= 2")


def clump(df: DataFrame, distance: int = 500_000) -> DataFrame:
    """Lead variants: by ascending p, each takes the ones within distance; greedy. Adds rank, by p within a chromosome.

    Found in rounds over the whole genome: a chromosome without gaps is no group."""
    leads = apart(df, distance, ["pval"])
    return leads.withColumn("rank", F.row_number().over(Window.partitionBy("chr").orderBy("pval", "pos")))


def align_to_ld(df: DataFrame, ld_variants: DataFrame) -> DataFrame:
    """df (variant_id, z, ...) on ld_variants (variant_id, idx): by id, else by the id with alleles exchanged and z turned.

    Ids are chr:pos:ref:alt with or without `chr`. Adds idx, flip."""
    norm = lambda c: F.regexp_replace(c, "^chr", "")
    parts = F.split(norm("variant_id"), ":")
    swapped = F.concat_ws(":", parts[0], parts[1], parts[3], parts[2])
    ids = ld_variants.select(norm("variant_id").alias("_id"), "idx")
    out = df.join(ids.select(F.col("_id").alias("_a"), F.col("idx").alias("_ia")), norm("variant_id") == F.col("_a"), "left")
    out = out.join(ids.select(F.col("_id").alias("_b"), F.col("idx").alias("_ib")), swapped == F.col("_b"), "left")
    out = out.withColumns({"idx": F.coalesce("_ia", "_ib"), "flip": F.when(F.col("_ia").isNotNull(), 1).otherwise(-1)}).where("idx IS NOT NULL")
    return out.withColumn("z", F.col("z") * F.col("flip")).drop("_a", "_b", "_ia", "_ib")


def report(df: DataFrame) -> dict[str, DataFrame]:
    """Counts with lambda, and lead variants of the genome-wide hits."""
    z = with_z(df).withColumn("chi2", F.col("z") * F.col("z"))
    counts = z.agg(F.count("*").alias("n"), F.count_if(F.col("pval") < 5e-8).alias("n_genome_wide"), F.count_if(F.col("pval") < 1e-5).alias("n_suggestive"), (F.percentile("chi2", 0.5) / 0.4549).alias("lambda_gc"))
    return {"counts": counts, "leads": clump(significant(df))}


def interpret(results: DataFrame) -> DataFrame:
    """One row of counts, lambda and a rule's verdict on the inflation."""
    row = results.agg(F.count("*").alias("n_tested"), F.count_if(F.col("p_value") < 5e-8).alias("n_hits"), (F.percentile("chi2", 0.5) / 0.4549).alias("lambda_gc"))
    text = F.when(F.col("lambda_gc") > 1.1, "inflated: correct for structure").when(F.col("lambda_gc") < 0.9, "deflated: check the model or power").otherwise("calibrated")
    return row.withColumn("verdict", text)
