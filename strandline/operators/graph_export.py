"""Node and edge tables of the sample-variant-gene graph, neighbour features, and a linear model over them.

Training of graph networks is left to whoever has the library; the label is never among the features here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(genotypes: DataFrame, samples: DataFrame, variants: DataFrame, variant_gene: DataFrame, af_range: tuple[float, float] = (0.001, 0.5), max_variants: int | None = None) -> dict[str, DataFrame]:
    """sample, variant and gene nodes with features, carries and in_gene edges; all variants, or the max_variants most
    carried ones."""
    n = samples.count()
    af = genotypes.groupBy("v").agg((F.sum("g") / (2.0 * n)).alias("af"), F.count("*").alias("carriers"), F.sum("g").alias("alleles"), F.lit(2 * n).alias("chromosomes")).where(F.col("af").between(*af_range))
    nodes = variants.select("v", "chr", "pos").join(af, "v")
    nodes = nodes if max_variants is None else nodes.orderBy(F.desc("carriers"), "v").limit(max_variants)
    in_gene = variant_gene.select("v", "gene").distinct().join(nodes.select("v"), "v", "left_semi")
    carries = genotypes.where("g > 0").join(nodes.select("v"), "v", "left_semi").select("s", "v", "g")
    load = carries.groupBy("s").agg(F.count("*").alias("n_carried"), F.sum("g").alias("burden"))
    gene = in_gene.groupBy("gene").agg(F.count("*").alias("n_variants"))
    sample = samples.select("s", F.col("is_case").alias("label")).join(load, "s", "left").fillna(0, ["n_carried", "burden"])
    return {"sample": sample, "variant": nodes, "gene": gene, "carries": carries, "in_gene": in_gene}


def neighbour_features(graph: dict[str, DataFrame]) -> DataFrame:
    """(s, own burden, mean af of carried variants, mean size of their genes): two rounds of mean aggregation."""
    size = graph["in_gene"].join(graph["gene"], "gene").groupBy("v").agg(F.sum("n_variants").alias("size"), F.count("*").alias("genes"))
    v = graph["variant"].select("v", "alleles", "chromosomes").join(size, "v", "left")
    sums = graph["carries"].join(v, "v").groupBy("s").agg(F.sum("alleles").alias("a"), F.sum("chromosomes").alias("c"), F.sum("size").alias("z"), F.sum("genes").alias("k"))
    near = sums.select("s", (F.col("a") / F.col("c")).alias("mean_af"), (F.col("z") / F.col("k")).alias("mean_gene_size"))  # of whole numbers: no order of sums shows
    return graph["sample"].join(near, "s", "left").fillna(0.0, ["mean_af", "mean_gene_size"])


def linear_substitute(features: DataFrame, columns: tuple[str, ...] = ("burden", "n_carried", "mean_af", "mean_gene_size"), seed: int = 42) -> DataFrame:
    """(s, label, score): logistic regression by MLlib, fitted on four samples in five by hash, scored on the fifth."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = features.where("label IS NOT NULL").withColumn("y", F.col("label").cast("double"))
    rows = VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows)
    fold = F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(5))
    train, test = rows.where(fold > 0), rows.where(fold == 0)
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="z", labelCol="y", regParam=0.01, maxIter=50).fit(scale.transform(train))
    return model.transform(scale.transform(test)).select("s", F.col("label").alias("is_case"), vector_to_array("probability")[1].alias("score"))
