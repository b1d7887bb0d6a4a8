"""Mendelian randomisation. Instruments: (v, bx, sx, by, sy), exposure and outcome effects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.special import normal_two_sided
from strandline.operators.greedy import independent
from strandline.operators.lineage import cut, ranked


def select_instruments(exposure: DataFrame, outcome: DataFrame, ld: DataFrame | None = None, p_threshold: float = 5e-8, r2_threshold: float = 0.01) -> DataFrame:
    """Exposure variants with p below the threshold that the outcome has, pruned: by ascending p (ties by v) a variant stays
    unless one that stayed is linked to it. exposure, outcome: (v, beta, se, p_value[, chr]); ld: (v1, v2, r2)."""
    x = exposure.where(F.col("p_value") < p_threshold).select("v", F.col("beta").alias("bx"), F.col("se").alias("sx"), F.col("p_value").alias("px"), *(["chr"] if "chr" in exposure.columns else []))
    both = x.join(outcome.select("v", F.col("beta").alias("by"), F.col("se").alias("sy")), "v").where("sx > 0 AND sy > 0")
    if ld is None:
        return both
    ids = both.select("v")
    near = ld.where(F.col("r2") >= r2_threshold).join(ids.withColumnRenamed("v", "v1"), "v1", "left_semi").join(ids.withColumnRenamed("v", "v2"), "v2", "left_semi")
    return independent(both, near.select(F.col("v1").alias("a"), F.col("v2").alias("b")), ["px"])


def ivw(instruments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fixed-effect inverse-variance weighting: n, estimate, se, z, p_value, cochran_q; by: one row for each group."""
    w = 1 / (F.col("sy") * F.col("sy"))
    bx, b = F.col("bx"), F.col("by")
    sums = (instruments.groupBy(*by) if by else instruments.groupBy()).agg(F.count("*").alias("n"), F.sum(bx * b * w).alias("xy"), F.sum(bx * bx * w).alias("xx"), F.sum(b * b * w).alias("yy"))
    out = sums.where("xx > 0").withColumns({"estimate": F.col("xy") / F.col("xx"), "se": F.sqrt(1 / F.col("xx"))})
    out = out.withColumn("z", F.col("estimate") / F.col("se")).withColumn("p_value", normal_two_sided(F.col("z")))
    return out.withColumn("cochran_q", F.col("yy") - F.col("estimate") * F.col("xy")).drop("xy", "xx", "yy")


def egger(instruments: DataFrame, min_n: int = 3) -> DataFrame:
    """Weighted regression with intercept, exposures oriented to be positive: n, estimate, se, intercept, intercept_se,
    p_value, intercept_p (normal); no row below min_n instruments."""
    w = 1 / (F.col("sy") * F.col("sy"))
    x, y = F.abs("bx"), F.col("by") * F.when(F.col("bx") < 0, -1.0).otherwise(1.0)
    s = instruments.agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"))
    c = F.col
    det = c("w") * c("wxx") - c("wx") * c("wx")
    s = s.where(f"n >= {min_n}").withColumn("det", det).where("det > 0")
    s = s.withColumn("estimate", (c("w") * c("wxy") - c("wx") * c("wy")) / c("det")).withColumn("intercept", (c("wxx") * c("wy") - c("wx") * c("wxy")) / c("det"))
    rss = c("wyy") - c("estimate") * c("wxy") - c("intercept") * c("wy")
    s = s.withColumn("sigma2", F.greatest(F.when(c("n") > 2, rss / (c("n") - 2)).otherwise(1.0), F.lit(1.0)))
    s = s.withColumn("se", F.sqrt(c("sigma2") * c("w") / c("det"))).withColumn("intercept_se", F.sqrt(c("sigma2") * c("wxx") / c("det")))
    return s.select("n", "estimate", "se", "intercept", "intercept_se", normal_two_sided(c("estimate") / c("se")).alias("p_value"), normal_two_sided(c("intercept") / c("intercept_se")).alias("intercept_p"))


def weighted_median_of(ratio: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(ratio, kind="stable")
    run = np.cumsum(weight[order]) / weight.sum()
    return float(ratio[order][min(np.searchsorted(run, 0.5), len(ratio) - 1)])


def weighted_median(instruments: DataFrame) -> DataFrame:
    """n, estimate: the Wald ratio at which the running weight (bx/sy)^2 reaches half; ties by v. Runs instruments.

    Ratios are sorted by range partitions; the driver holds a sum for each, and one partition is looked through."""
    spark = instruments.sparkSession
    rows = instruments.where("bx <> 0").select("v", (F.col("by") / F.col("bx")).alias("ratio"), F.pow(F.col("bx") / F.col("sy"), 2).alias("w"))
    placed = cut(rows.repartitionByRange("ratio", "v").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["n"], r["w"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect())
    total, run, estimate = sum(w for _, _, w in sums), 0.0, None
    for part, _, w in sums:
        if run + w >= 0.5 * total - 1e-12 * total:
            over = Window.partitionBy("part").orderBy("ratio", "v").rowsBetween(Window.unboundedPreceding, 0)
            inside = placed.where(F.col("part") == part).withColumn("run", F.sum("w").over(over) + run)
            hit = inside.where(F.col("run") >= 0.5 * total).orderBy("ratio", "v").first()
            if hit is not None:
                estimate = float(hit["ratio"])
                break
        run += w
    return spark.createDataFrame([(sum(n for _, n, _ in sums), estimate)], "n long, estimate double")


#: Instruments that every draw of the bootstrap holds.
MAX_INSTRUMENTS = 1_000_000


def weighted_median_se(instruments: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """estimate, se, p_value: parametric bootstrap, a seed for each block of draws, so that partitions do not matter."""
    some = instruments.where("bx <> 0").select("v", "bx", "sx", "by", "sy").orderBy("v").limit(MAX_INSTRUMENTS + 1).toPandas()
    if len(some) > MAX_INSTRUMENTS:
        raise ValueError(f"more than {MAX_INSTRUMENTS} instruments: select and prune them first")
    rows = some
    if rows.empty:
        return instruments.sparkSession.createDataFrame([], "estimate double, se double, p_value double")
    bx, sx, b, sy = (rows[c].to_numpy(float) for c in ("bx", "sx", "by", "sy"))

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                x, y = rng.normal(bx, sx), rng.normal(b, sy)
                out.append(weighted_median_of(y / np.where(x == 0, 1e-12, x), (bx / sy) ** 2))
            yield pd.DataFrame({"m": out})

    sd = instruments.sparkSession.range(draws).mapInPandas(run, "m double").agg(F.stddev_samp("m").alias("se"))
    est = weighted_median_of(b / bx, (bx / sy) ** 2)
    out = sd.select(F.lit(est).alias("estimate"), "se")
    return out.withColumn("p_value", normal_two_sided(F.col("estimate") / F.col("se")))


def pleiotropy_classes(instruments: DataFrame, variant_pathway: DataFrame) -> DataFrame:
    """(v, status): valid, pleiotropic or unknown by pathways outside those of the top third by |bx|/sx."""
    strength = ranked(instruments.withColumn("_x", -F.abs(F.col("bx")) / F.col("sx")), "_x", "v", name="_r")
    top = max(1, math.ceil(instruments.count() / 3))
    paths = variant_pathway.select("v", "pathway").distinct()
    core = paths.join(strength.where(F.col("_r") <= top).select("v"), "v", "left_semi").select("pathway").distinct()
    outside = paths.join(core, "pathway", "left_anti").select("v").distinct().withColumn("_outside", F.lit(True))
    rows = strength.select("v").join(paths.select("v").distinct().withColumn("_known", F.lit(True)), "v", "left").join(outside, "v", "left")
    return rows.select("v", F.when(F.col("_known").isNull(), "unknown").when(F.col("_outside"), "pleiotropic").otherwise("valid").alias("status"))


def by_pathway(instruments: DataFrame, variant_pathway: DataFrame) -> DataFrame:
    return ivw(instruments.join(variant_pathway.select("v", "pathway").distinct(), "v"), ["pathway"])


def report(instruments: DataFrame) -> dict[str, DataFrame]:
    return {"ivw": ivw(instruments), "egger": egger(instruments), "weighted_median": weighted_median_se(instruments)}
