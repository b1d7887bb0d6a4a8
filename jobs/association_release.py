"""A release of association results: python -m jobs.association_release --data DIR --out PATH [--phenotypes PATH] [--config PATH]

Every trait of the configuration is scanned against all variants of the panel (quantitative: linear, from sums; binary:
allelic chi-squared), with the number of tests, the genomic control lambda and genes within a window. Traits are SQL
aggregates over a table of --data by sample; --phenotypes adds those that jobs.note_phenotypes wrote (out/cases), whose
controls are the samples with notes.

  out/results  partitioned by trait and chr
  out/genes    partitioned by trait: each gene's variants, hits and least p

Partitions are replaced whole: a rerun gives the same tables, a release of some traits leaves those of others alone.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, replace_partitions, shipped_config, table_or_empty
from jobs.note_phenotypes import ALL
from strandline.operators import assoc, genotype, intervals
from strandline.operators.lineage import written
from strandline.plans import panel

RESULTS = "v long, variant_id string, pos long, beta double, chi2 double, p_value double, n_tests long, lambda_gc double, is_hit boolean, trait string, chr int"
GENES = "gene long, n_variants long, n_hits long, min_p double, trait string"


def samples_of(spark: SparkSession, data: str, trait: dict) -> DataFrame:
    """(s, y) or (s, is_case) of a trait of the configuration."""
    kind, name = ("boolean", "is_case") if trait["kind"] == "binary" else ("double", "y")
    rows = panel.table(spark, data, trait["table"]).where(f"{trait['sample']} IS NOT NULL")
    return rows.groupBy(F.expr(trait["sample"]).alias("s")).agg(F.expr(trait["value"]).cast(kind).alias(name))


def noted(cases: DataFrame, phenotype: str) -> DataFrame:
    """(s, is_case) of a phenotype from notes."""
    own = cases.where(F.col("phenotype") == phenotype).select("s", "is_case")
    return cases.where(F.col("phenotype") == ALL).select("s").join(own, "s", "left").select("s", F.coalesce("is_case", F.lit(False)).alias("is_case"))


def scan(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """(v, beta, chi2, p_value) of one trait."""
    if "is_case" in samples.columns:
        return assoc.chi2_allelic(genotype.count_tables(genotypes, samples)).select("v", "beta", "chi2", "p_value")
    r = assoc.linear_stats(genotype.moments(genotypes, samples))
    return r.select("v", "beta", (F.col("t") * F.col("t")).alias("chi2"), assoc.chi2_1_tail(F.col("t") * F.col("t")).alias("p_value"))


def association_release(spark: SparkSession, data: str, out: str, config: dict, phenotypes: str | None = None) -> DataFrame:
    """Writes out/results and out/genes for the traits of the configuration and returns out/results as written."""
    genotypes, variants, genes = panel.genotypes(spark, data), panel.variants(spark, data), panel.genes(spark, data).select("gene", "chr", "start", "end")
    traits = {t["name"]: samples_of(spark, data, t) for t in config["traits"]}
    if phenotypes:
        cases = spark.read.parquet(phenotypes)
        traits |= {f"notes_{p}": noted(cases, p) for p in config.get("note_phenotypes", [])}
    # Genotypes meet the traits of all samples once, however many traits there are.
    for k, (name, samples) in enumerate(traits.items()):
        traits[name] = written(samples)
        one = traits[name].select("s", F.col(traits[name].columns[1]).alias(f"t{k}"))
        wide = wide.join(one, "s", "full") if k else one
    if traits:
        genotypes = genotypes.join(wide, "s", "left")
    genotypes = written(genotypes)
    log.info("read %d genotypes, %d variants of %s", genotypes.count(), variants.count(), data)
    place = variants.select("v", "variant_id", "pos", "chr")
    for k, (name, samples) in enumerate(traits.items()):
        tested = written(scan(genotypes.select("v", "s", "g", F.col(f"t{k}").alias(samples.columns[1])), samples))
        level = tested.agg(F.count("*").alias("n_tests"), (F.percentile("chi2", 0.5) / 0.4549).alias("lambda_gc")).first()
        hit = (F.col("p_value") * level["n_tests"] <= config["p_hit"]).alias("is_hit")
        named = [F.lit(level["n_tests"]).cast("long").alias("n_tests"), F.lit(level["lambda_gc"]).cast("double").alias("lambda_gc"), hit, F.lit(name).alias("trait")]
        rows = tested.join(place, "v").select("v", "variant_id", "pos", "beta", "chi2", "p_value", *named, "chr")
        replace_partitions(rows, f"{out}/results", "trait", "chr")
    results = spark.read.schema(RESULTS).parquet(f"{out}/results")
    own = results.where(F.col("trait").isin(*traits))
    near = intervals.interval_join(own.select("chr", "pos", "p_value", "is_hit", "trait"), genes, config["window"])
    sums = near.groupBy("gene", "trait").agg(F.count("*").alias("n_variants"), F.count_if("is_hit").alias("n_hits"), F.min("p_value").alias("min_p"))
    replace_partitions(sums.select("gene", "n_variants", "n_hits", "min_p", "trait"), f"{out}/genes", "trait")
    n_results, n_genes = (dict(df.groupBy("trait").count().collect()) for df in (own, table_or_empty(spark, f"{out}/genes", GENES)))
    for name in traits:
        log.info("wrote %s: trait %s with %d results, %d genes", out, name, n_results.get(name, 0), n_genes.get(name, 0))
    return results


def main(argv: list[str] | None = None) -> None:
    from strandline.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--out", required=True)
    p.add_argument("--phenotypes", help="out/cases of jobs.note_phenotypes; names by note_phenotypes of the configuration")
    p.add_argument("--config", help="TOML; default: the one beside this file")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("association_release")
    try:
        config = read_config(spark, a.config) if a.config else shipped_config("association_release")
        association_release(spark, a.data, a.out, config, a.phenotypes)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
