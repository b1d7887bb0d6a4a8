"""A deterministic association panel out of the star-schema tables, the same in Spark and as SQL.

sample: customers (trait y, cases by segment, population); variant: (supplier, k) with dosages from line items, nested
thresholds make real linkage blocks; gene: the block; pathway, interactions, expression links by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, y, is_case, population)"""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("s"), F.col("c_acctbal").alias("y"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("is_case"), F.col("c_nationkey").alias("population"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, s, g): dosages 1 and 2; absent pairs are 0. One shuffle, pre-aggregated."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.explode(F.filter(F.array(*[F.lit(x) for x in range(4)]), lambda x: F.col("l_quantity") <= 13 * (x + 1))).alias("k")
    hit = li.join(o, li.l_orderkey == o.o_orderkey).select("l_suppkey", F.col("o_custkey").alias("s"), k)
    return hit.groupBy((F.col("l_suppkey") * 4 + F.col("k")).alias("v"), "s").agg(F.least(F.lit(2), F.count("*")).cast("int").alias("g"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, chr, pos, gene, variant_id)"""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("k"))
    chr_, pos = F.expr("CAST(b % 5 + 1 AS INT)"), F.expr("(b div 5) * 100000 + k * 1000 + 1")
    return s.select((F.col("b") * 4 + F.col("k")).alias("v"), chr_.alias("chr"), pos.alias("pos"), F.col("b").alias("gene"), F.concat(F.lit("chr"), chr_, F.lit(":"), pos, F.lit(":A:G")).alias("variant_id"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, chr, start, end, pathway)"""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gene", "CAST(s_suppkey % 5 + 1 AS INT) AS chr", "(s_suppkey div 5) * 100000 + 1 AS start", "(s_suppkey div 5) * 100000 + 3001 AS end", "s_nationkey AS pathway")


def gene_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, pathway): m:n, by nation and by remainder."""
    s = table(spark, sf_dir, "supplier")
    return s.selectExpr("s_suppkey AS gene", "concat('N', s_nationkey) AS pathway").union(s.selectExpr("s_suppkey AS gene", "concat('M', s_suppkey % 7) AS pathway"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, score), a < b"""
    s = table(spark, sf_dir, "supplier")
    top = s.select(F.col("s_suppkey").alias("b")).where("b > 0")
    return top.selectExpr("b - 1 AS a", "b", "((b - 1) * 37 + b * 11) % 300 + 700 AS score")


#: DuckDB common table expressions of the same relations.
PANEL = """
sample AS (SELECT c_custkey AS s, c_acctbal AS y, c_mktsegment IN ('BUILDING','MACHINERY') AS is_case, c_nationkey AS population FROM customer),
genotype AS (SELECT l_suppkey*4+k AS v, o_custkey AS s, CAST(least(2,count(*)) AS INT) AS g
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey, (VALUES (0),(1),(2),(3)) kk(k) WHERE l_quantity <= 13*(k+1) GROUP BY 1,2),
variant AS (SELECT s_suppkey*4+k AS v, CAST(s_suppkey%5+1 AS INT) AS chr, (s_suppkey//5)*100000+k*1000+1 AS pos, s_suppkey AS gene,
  concat('chr',CAST(s_suppkey%5+1 AS INT),':',(s_suppkey//5)*100000+k*1000+1,':A:G') AS variant_id FROM supplier, (VALUES (0),(1),(2),(3)) kk(k)),
gene AS (SELECT s_suppkey AS gene, CAST(s_suppkey%5+1 AS INT) AS chr, (s_suppkey//5)*100000+1 AS "start", (s_suppkey//5)*100000+3001 AS "end", s_nationkey AS pathway FROM supplier),
gene_pathway AS (SELECT s_suppkey AS gene, concat('N',s_nationkey) AS pathway FROM supplier UNION ALL SELECT s_suppkey, concat('M',s_suppkey%7) FROM supplier),
ppi AS (SELECT s_suppkey-1 AS a, s_suppkey AS b, ((s_suppkey-1)*37+s_suppkey*11)%300+700 AS score FROM supplier WHERE s_suppkey>0),
n AS (SELECT count(*) AS n, CAST(sum(CASE WHEN is_case THEN 1 ELSE 0 END) AS BIGINT) AS n_case, avg(y) AS my, var_pop(y) AS vy FROM sample)
"""
