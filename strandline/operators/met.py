"""Multi-environment trials. Observations: (genotype, environment, rep, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import adjacency, connected_components, louvain, path_betweenness


def dimensions(obs: DataFrame, covariates: list[str] = ()) -> dict[str, DataFrame]:
    """environments (location and year split from the name, covariates of the first row by rep) and genotypes."""
    parts = F.split("environment", "_")
    env = obs.groupBy("environment").agg(*[F.min_by(c, F.struct("rep", "genotype")).alias(c) for c in covariates], F.count("*").alias("n_obs"))
    year = F.expr("try_cast(element_at(split(environment, '_'), -1) AS INT)")
    return {"environments": env.withColumns({"location": parts[0], "year": year}), "genotypes": obs.select("genotype").distinct()}


def cell_means(obs: DataFrame) -> DataFrame:
    return obs.where("value IS NOT NULL").groupBy("genotype", "environment").agg(F.avg("value").alias("m"))


def environment_similarity(obs: DataFrame, min_shared: int = 10) -> DataFrame:
    """(env1, env2, n_shared, r_g), env1 < env2: correlation of cell means over shared genotypes, 0 below min_shared."""
    c = cell_means(obs)
    a, b = c.select("genotype", F.col("environment").alias("env1"), F.col("m").alias("x")), c.select("genotype", F.col("environment").alias("env2"), F.col("m").alias("y"))
    both = a.join(b, "genotype").where("env1 < env2").groupBy("env1", "env2")
    ok = (F.count("*") >= min_shared) & (F.var_pop("x") > 0) & (F.var_pop("y") > 0)
    return both.agg(F.count("*").alias("n_shared"), F.when(ok, F.corr("x", "y")).otherwise(0.0).alias("r_g"))


def mega_environments(obs: DataFrame, resolution: float = 1.0, min_shared: int = 10) -> DataFrame:
    """(environment, cluster) by Louvain on positive r_g; environments are few: one group."""
    near = environment_similarity(obs, min_shared).where("r_g > 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = louvain(adjacency(pdf[["env1", "env2", "r_g"]].itertuples(index=False)), resolution)
        return pd.DataFrame({"environment": list(part), "cluster": list(part.values())})

    found = near.groupBy(F.lit(1).alias("one")).applyInPandas(run, "environment string, cluster long")
    return obs.select("environment").distinct().join(found, "environment", "left")


def gwas_readiness(obs: DataFrame, samples: DataFrame, min_n: int = 20) -> DataFrame:
    """(environment, n, n_genotyped, ready)"""
    rows = obs.where("value IS NOT NULL").select("environment", "genotype").distinct().join(samples.select(F.col("s").alias("genotype"), F.lit(1).alias("k")), "genotype", "left")
    return rows.groupBy("environment").agg(F.count("*").alias("n"), F.count("k").alias("n_genotyped")).withColumn("ready", F.col("n_genotyped") >= min_n)


def reaction_norms(effects: DataFrame, covariate: DataFrame | None = None, top_n: int = 100) -> DataFrame:
    """effects (v, environment, beta): v, n_env, beta_variance, beta_range, and slope and r2 on covariate (environment, x)
    where three environments or more have one; the top_n by variance."""
    rows = effects if covariate is None else effects.join(covariate.select("environment", "x"), "environment", "left")
    out = [F.count("*").alias("n_env"), F.var_pop("beta").alias("beta_variance"), (F.max("beta") - F.min("beta")).alias("beta_range")]
    if covariate is not None:
        ok = (F.count("x") >= 3) & (F.var_pop("x") > 0)
        out += [F.when(ok, F.regr_slope("beta", "x")).alias("slope"), F.when(ok, F.regr_r2("beta", "x")).alias("r2")]
    return rows.groupBy("v").agg(*out).where("n_env >= 2").orderBy(F.desc("beta_variance"), "v").limit(top_n)


def gxe(obs: DataFrame) -> DataFrame:
    """One row: var_g, var_e (of genotype and environment means of cell means), var_gxe (residual), h2, gxe_share, r_b."""
    c = cell_means(obs)
    rows = c.withColumn("g", F.avg("m").over(Window.partitionBy("genotype"))).withColumn("e", F.avg("m").over(Window.partitionBy("environment")))
    grand = rows.agg(F.avg("m")).first()[0]
    if grand is None:
        return obs.sparkSession.createDataFrame([], "var_g double, var_e double, var_gxe double, h2 double, gxe_share double, r_b double")
    res = rows.agg(F.var_pop(F.col("m") - F.col("g") - F.col("e") + F.lit(grand)).alias("var_gxe")).first()[0]
    g = rows.select("genotype", "g").distinct().agg(F.var_pop("g")).first()[0]
    out = rows.select("environment", "e").distinct().agg(F.var_pop("e").alias("var_e")).select(F.lit(g).alias("var_g"), "var_e", F.lit(res).alias("var_gxe"))
    total = F.col("var_g") + F.col("var_e") + F.col("var_gxe")
    both = F.col("var_g") + F.col("var_gxe")
    return out.withColumns({"h2": F.when(total > 0, F.col("var_g") / total).otherwise(0.0), "gxe_share": F.when(total > 0, F.col("var_gxe") / total).otherwise(0.0), "r_b": F.when(both > 0, F.col("var_g") / both).otherwise(0.0)})


def design(obs: DataFrame) -> dict[str, DataFrame]:
    """balance: one row of counts; components of the genotype-environment graph; betweenness of environments linked by
    shared genotypes."""
    cells = obs.select("genotype", "environment").distinct()
    balance = cells.agg(F.count_distinct("genotype").alias("n_genotypes"), F.count_distinct("environment").alias("n_environments"), F.count("*").alias("n_cells")).withColumn("balance", F.col("n_cells") / (F.col("n_genotypes") * F.col("n_environments")))
    parts = connected_components(cells.select(F.concat(F.lit("g:"), "genotype").alias("a"), F.concat(F.lit("e:"), "environment").alias("b")).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    near = cells.join(cells.select("genotype", F.col("environment").alias("e2")), "genotype").where("environment < e2").groupBy("environment", "e2").agg(F.count("*").cast("double").alias("w"))

    through = path_betweenness(near.select(F.col("environment").alias("a"), F.col("e2").alias("b")))
    n = through.count()
    score = through.select(F.col("node").alias("environment"), (F.col("paths_through") / max((n - 1) * (n - 2), 1)).alias("betweenness"))
    return {"balance": balance, "components": parts.agg(F.count_distinct("component").alias("n_components")), "betweenness": score}


def impute(obs: DataFrame, genotype, environment, k_neighbors: int = 10, min_shared: int = 3) -> DataFrame:
    """One row: value, n_neighbors, confidence for a missing cell: the k genotypes that correlate best over shared
    environments and were seen in this one, weighted by positive correlation of deviations."""
    c = cell_means(obs)
    own = c.where(F.col("genotype") == genotype).select("environment", F.col("m").alias("x"))
    both = c.where(F.col("genotype") != genotype).join(own, "environment").groupBy("genotype").agg(F.count("*").alias("n"), F.corr("m", "x").alias("r"))
    here = c.where(F.col("environment") == environment).select("genotype", "m")
    near = both.where((F.col("n") >= min_shared) & (F.col("r") > 0) & ~F.isnan("r")).join(here, "genotype").orderBy(F.desc("r"), "genotype").limit(k_neighbors)
    return near.agg((F.sum(F.col("r") * F.col("m")) / F.sum("r")).alias("value"), F.count("*").alias("n_neighbors"), F.avg("r").alias("confidence"))
