"""Gene-level tests of correlated statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.special import chi2_sf, normal_two_sided


def directed(z: DataFrame, ld: DataFrame, min_variants: int = 2) -> DataFrame:
    """(gene, n, stat, p_value): sum of z over the root of the sum of correlations. z: (gene, v, z); ld: (v1, v2, r)."""
    own = z.groupBy("gene").agg(F.count("*").alias("n"), F.sum("z").alias("sz")).where(F.col("n") >= min_variants)
    a, b = z.select("gene", F.col("v").alias("v1")), z.select("gene", F.col("v").alias("v2"))
    cross = a.join(ld, "v1").join(b, ["gene", "v2"]).groupBy("gene").agg(F.sum("r").alias("sr"))
    out = own.join(cross, "gene", "left").withColumn("var", F.col("n") + 2 * F.coalesce("sr", F.lit(0.0)))
    out = out.withColumn("stat", F.when(F.col("var") > 0, F.col("sz") / F.sqrt("var")).otherwise(0.0))
    return out.select("gene", "n", "stat", normal_two_sided(F.col("stat")).alias("p_value"))


def liu_tail(q: float, lam: np.ndarray) -> float:
    """P of a weighted sum of chi-squares beyond q by matching four moments."""
    c = [float((lam**k).sum()) for k in (1, 2, 3, 4)]
    s1, s2 = c[2] / c[1] ** 1.5, c[3] / c[1] ** 2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        d = s1 * a**3 - a * a
        df = a * a - 2 * d
    else:
        a, d, df = 1 / s1, 0.0, 1 / (s1 * s1)
    df = max(df, 1e-6)
    x = (q - c[0]) / math.sqrt(2 * c[1]) * math.sqrt(2) * a + df + d
    if d <= 1e-12:
        return chi2_sf(max(x, 0.0), df)
    # Non-central: a Poisson mixture of central tails.
    p, w = 0.0, math.exp(-d / 2)
    for k in range(200):
        p += w * chi2_sf(max(x, 0.0), df + 2 * k)
        w *= d / 2 / (k + 1)
    return min(1.0, p)


def undirected(z: DataFrame, ld: DataFrame, min_variants: int = 2) -> DataFrame:
    """(gene, n, stat, p_value): sum of z^2 against its mixture, eigenvalues of the gene's correlations above 1e-6."""
    none = F.lit(None)
    pairs = z.select("gene", F.col("v").alias("v1")).join(ld, "v1").join(z.select("gene", F.col("v").alias("v2")), ["gene", "v2"])
    rows = z.select("gene", F.col("v").alias("v1"), "z", none.cast("long").alias("v2"), none.cast("double").alias("r")).union(pairs.select("gene", "v1", none.cast("double"), "v2", "r"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["v2"].isna()].sort_values("v1")
        if len(own) < min_variants:
            return pd.DataFrame({"gene": [], "n": [], "stat": [], "p_value": []})
        at = {v: k for k, v in enumerate(own["v1"])}
        r = np.eye(len(at))
        for a, b, x in pdf[pdf["v2"].notna()][["v1", "v2", "r"]].itertuples(index=False):
            r[at[a], at[b]] = r[at[b], at[a]] = x
        lam = np.linalg.eigvalsh(r)
        q = float((own["z"] ** 2).sum())
        return pd.DataFrame({"gene": [own["gene"].iloc[0]], "n": [len(own)], "stat": [q], "p_value": [liu_tail(q, lam[lam > 1e-6])]})

    return rows.groupBy("gene").applyInPandas(run, f"gene {z.schema['gene'].dataType.simpleString()}, n long, stat double, p_value double")
