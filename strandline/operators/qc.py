"""Variant and sample quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import hwe_p
from strandline.operators.genotype import count_tables


def variant_qc(genotypes: DataFrame, samples: DataFrame, mac_min: int = 5, hwe_min: float = 1e-10) -> DataFrame:
    """v, mac_cases, mac_controls, af_controls, hwe_pvalue_controls, passed."""
    c = count_tables(genotypes, samples)
    alt = lambda g: F.col(f"{g}_ha") * 2 + F.col(f"{g}_het")
    size = lambda g: F.col(f"{g}_hr") + F.col(f"{g}_het") + F.col(f"{g}_ha")
    mac = lambda g: F.least(alt(g), size(g) * 2 - alt(g))
    out = c.select("v", mac("case").alias("mac_cases"), mac("ctrl").alias("mac_controls"), F.when(size("ctrl") > 0, alt("ctrl") / (size("ctrl") * 2)).alias("af_controls"), hwe_p("ctrl_het", F.least("ctrl_ha", "ctrl_hr"), size("ctrl")).alias("hwe_pvalue_controls"))
    return out.withColumn("passed", (F.col("mac_cases") + F.col("mac_controls") >= mac_min) & (F.col("hwe_pvalue_controls") >= hwe_min))


def sample_qc(genotypes: DataFrame, samples: DataFrame, n_variants: int, missing_max: float = 0.05, sd_max: float = 3.0) -> DataFrame:
    """s, genotype_missingness, het_rate, is_excluded_qc, exclusion_reason.

    A sample goes when more than missing_max is missing or its heterozygosity is beyond sd_max population deviations."""
    per = genotypes.groupBy("s").agg(F.count_if(F.col("g").isNull()).alias("m"), F.count_if(F.col("g") == 1).alias("h"))
    all_ = samples.select("s").join(per, "s", "left").select("s", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("h", F.lit(0)).alias("h"))
    rates = all_.select("s", (F.col("m") / n_variants).alias("genotype_missingness"), F.when(F.lit(n_variants) > F.col("m"), F.col("h") / (n_variants - F.col("m"))).otherwise(0.0).alias("het_rate"))
    stats = rates.agg(F.avg("het_rate").alias("a"), F.stddev_pop("het_rate").alias("d")).first()
    mean, sd = float(stats["a"] or 0), float(stats["d"] or 0)
    reasons = F.array_compact(F.array(F.when(F.col("genotype_missingness") > missing_max, F.lit("missingness")), F.when(F.abs(F.col("het_rate") - mean) > sd_max * sd, F.lit("heterozygosity"))))
    return rates.withColumn("is_excluded_qc", F.size(reasons) > 0).withColumn("exclusion_reason", F.concat_ws("; ", reasons))
