"""Annotation joins: intervals by bins, loaders' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, flank: int = 0, width: int = 1 << 16) -> DataFrame:
    """points (chr, pos, ...) within intervals (chr, start, end, ...) widened by flank; adds distance_bp, 0 inside.

    Only the interval side is exploded into the bins that it covers, so a pair meets once; equi-join on (chr, bin), the
    interval test is residual: no product and no nested loops."""
    bins = F.explode(F.sequence(F.floor((F.col("start") - flank) / width), F.floor((F.col("end") + flank) / width))).alias("_bin")
    spread = intervals.select("*", bins)
    placed = points.withColumn("_bin", F.floor(F.col("pos") / width))
    hit = placed.join(spread, ["chr", "_bin"]).where((F.col("pos") >= F.col("start") - flank) & (F.col("pos") <= F.col("end") + flank))
    gap = F.when(F.col("pos") < F.col("start"), F.col("start") - F.col("pos")).when(F.col("pos") > F.col("end"), F.col("pos") - F.col("end")).otherwise(0)
    return hit.withColumn("distance_bp", gap).drop("_bin")


def gene_counts(variant_gene: DataFrame) -> DataFrame:
    """gene, n_variants_total, n_high_impact, n_moderate_impact, n_rare_functional; variant_gene has impact and af."""
    hi = F.col("impact").isin("HIGH", "MODERATE")
    return variant_gene.groupBy("gene").agg(F.count("*").alias("n_variants_total"), F.count_if(F.col("impact") == "HIGH").alias("n_high_impact"), F.count_if(F.col("impact") == "MODERATE").alias("n_moderate_impact"), F.count_if(hi & (F.col("af") < 0.01)).alias("n_rare_functional"))


def undirected(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """One row for each unordered pair, the first by `order`; self pairs go."""
    pair = edges.where(F.col(a) != F.col(b)).withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    rest = [c for c in edges.columns if c not in (a, b)]
    first = pair.groupBy("_lo", "_hi").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(F.col("_lo").alias("a"), F.col("_hi").alias("b"), *[F.col(f"r.{c}").alias(c) for c in rest])
