"""Structural variants: gene matrices beside single-nucleotide ones. Dense long form: (v, s, g), plus type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.assoc import linear_stats, t_p
from strandline.operators.lineage import md5_number


def long_matrix(wide: DataFrame, id_column: str, variant_type: str, samples_are_rows: bool = True, skip: tuple[str, ...] = ()) -> DataFrame:
    """(v, s, g, type) of a wide matrix; variants without variance go; ids are `type_gene`."""
    columns = [c for c in wide.columns if c != id_column and c not in skip]
    cells = wide.select(F.col(id_column).cast("string").alias("_id"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in columns]).unpivot("_id", columns, "_name", "g").where("g IS NOT NULL")
    gene, sample = ("_name", "_id") if samples_are_rows else ("_id", "_name")
    out = cells.select(F.concat(F.lit(f"{variant_type}_"), F.col(gene)).alias("v"), F.col(sample).alias("s"), "g", F.lit(variant_type).alias("type"))
    spread = out.groupBy("v").agg(F.var_pop("g").alias("x")).where("x > 0").select("v")
    return out.join(spread, "v", "left_semi")


def combine(matrices: dict[str, DataFrame]) -> DataFrame:
    """Union of (v, s, g) matrices over the samples that all have."""
    common, out = None, None
    for df in matrices.values():
        s = df.select("s").distinct()
        common = s if common is None else common.intersect(s)
    for kind, df in matrices.items():
        part = df.select(F.col("v").cast("string").alias("v"), "s", F.col("g").cast("double").alias("g"), F.lit(kind).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out.join(common, "s", "left_semi")


def dense_moments(cells: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """Regression sums of dense cells, missing ones imputed by the mean: n, sg, sgg, sgy, sy, syy."""
    rows = cells.join(samples.where("y IS NOT NULL").select("s", "y"), "s")
    miss = F.col("g").isNull()
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(miss).alias("m"), F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sgg"), F.sum(F.col("g") * F.col("y")).alias("sgy"), F.sum(F.when(miss, F.col("y")).otherwise(0.0)).alias("my"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    mean = F.when(F.col("n") > F.col("m"), F.col("sg") / (F.col("n") - F.col("m"))).otherwise(0.0)
    return base.select(*by, "n", (F.coalesce("sg", F.lit(0.0)) + mean * F.col("m")).alias("sg"), (F.coalesce("sgg", F.lit(0.0)) + mean * mean * F.col("m")).alias("sgg"), (F.coalesce("sgy", F.lit(0.0)) + mean * F.col("my")).alias("sgy"), "sy", "syy")


def fast_gwas(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """v, n, beta, r2, t, se, p_value for dense cells; monomorphic: 0 and 1."""
    return linear_stats(dense_moments(cells, samples, ["v"])).withColumn("p_value", t_p("t", F.col("n") - 2))


def by_type(results: DataFrame, types: DataFrame) -> DataFrame:
    """(type, n, n_bonferroni, n_suggestive, min_p, fraction) with thresholds 0.05/m and 1e-4."""
    m = results.count()
    rows = results.join(types.select(F.col("v"), "type").distinct(), "v").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("p_value") < 0.05 / max(m, 1)).alias("n_bonferroni"), F.count_if(F.col("p_value") < 1e-4).alias("n_suggestive"), F.min("p_value").alias("min_p"))
    return rows.withColumn("fraction", F.col("n") / F.lit(m))


def heritability(cells: DataFrame, samples: DataFrame, n_top: int = 50) -> DataFrame:
    """(set, n_variants, r2): scores trained on samples whose md5 number is even, tested on the others, for each type and all."""
    parity = samples.where("y IS NOT NULL").withColumn("k", md5_number(F.col("s")) % 2)
    train, test = parity.where("k = 0"), parity.where("k = 1")
    typed = cells.withColumn("set", F.explode(F.array(F.col("type"), F.lit("all"))))
    fit = linear_stats(dense_moments(typed, train, ["set", "v"]).withColumn("v", F.struct("set", "v"))).select("v.set", F.col("v.v").alias("v"), "beta", F.abs("t").alias("a"))
    best = fit.withColumn("r", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("a"), "v"))).where(F.col("r") <= n_top)
    score = typed.join(best.select("set", "v", "beta"), ["set", "v"]).join(test.select("s", "y"), "s").groupBy("set", "s").agg(F.sum(F.col("beta") * F.coalesce("g", F.lit(0.0))).alias("x"), F.first("y").alias("y"))
    return score.groupBy("set").agg(F.count("*").alias("n_samples"), F.when((F.var_pop("x") > 0) & (F.var_pop("y") > 0), F.pow(F.corr("x", "y"), 2)).otherwise(0.0).alias("r2"))


def pleiotropy(results: DataFrame, types: DataFrame, p_threshold: float = 1e-4) -> DataFrame:
    """(type, n, n_pleiotropic, max_traits) of results (trait, v, p_value)."""
    per = results.groupBy("v").agg(F.count_distinct(F.when(F.col("p_value") < p_threshold, F.col("trait"))).alias("k"))
    return per.join(types.select("v", "type").distinct(), "v").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 2).alias("n_pleiotropic"), F.max("k").alias("max_traits"))
