"""Bias diagnostics of residual-interaction scans: how far a fixed set Z explains a genotype g."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import erfc_col, normal_sf


def preprocess(g: np.ndarray, z: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both centred, after projecting covariates out."""
    cols = np.column_stack([np.ones(len(g)), *([x] if x is not None else [])])
    res = lambda m: m - cols @ np.linalg.lstsq(cols, m, rcond=None)[0]
    return res(np.asarray(g, float)), res(np.atleast_2d(np.asarray(z, float).T).T)


def rho_max(g: np.ndarray, z: np.ndarray, x: np.ndarray | None = None) -> float:
    """Norm of the projection of g on Z over the norm of g."""
    g, z = preprocess(g, z, x)
    norm = np.linalg.norm(g)
    return float(np.linalg.norm(z @ np.linalg.lstsq(z, g, rcond=None)[0]) / norm) if norm > 0 else 0.0


def rho_one(genotypes: DataFrame, z: DataFrame) -> DataFrame:
    """(v, rho): one column Z (s, z), absolute correlation by aggregation over dense cells (v, s, g)."""
    rows = genotypes.join(z, "s").groupBy("v")
    ok = (F.var_pop("g") > 0) & (F.var_pop("z") > 0)
    return rows.agg(F.when(ok, F.abs(F.corr("g", "z"))).otherwise(0.0).alias("rho"))


def _valid(lam: float) -> None:
    if not 0 <= lam < 1:
        raise ValueError("lambda must be in [0, 1)")


def mu_shift(rho: Column, lam: float, n: int) -> Column:
    _valid(lam)
    return rho * math.sqrt(lam * n) / F.sqrt(1 - lam * rho * rho)


def sigma_res_sq(rho: Column, lam: float) -> Column:
    _valid(lam)
    return (1 - lam * rho * rho) / (1 - lam)


def conservativeness(x: float, n: int, lam: float, rho: float) -> float:
    """Tail beyond x under the shifted normal over that under the standard one, both sides."""
    _valid(lam)
    mu = rho * math.sqrt(lam * n) / math.sqrt(1 - lam * rho * rho)
    return float((normal_sf(x - mu) + normal_sf(x + mu)) / (2 * normal_sf(x)))


def diagnostic(rhos: DataFrame, n: int, lam: float, x: float = 5.45) -> DataFrame:
    """Adds mu, sigma2 and ratio to (v, rho)."""
    r = F.col("rho")
    root = math.sqrt(2.0)
    out = rhos.withColumns({"mu": mu_shift(r, lam, n), "sigma2": sigma_res_sq(r, lam)})
    return out.withColumn("ratio", (erfc_col((F.lit(x) - F.col("mu")) / root) + erfc_col((F.lit(x) + F.col("mu")) / root)) / (2 * erfc_col(F.lit(x / root))))
