"""Result tables, schema checks and phenotypes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut

RESULT_COLUMNS = ["run_id", "variant_id", "phenotype_key", "method", "beta", "se", "p_value", "p_value_log10", "odds_ratio", "ci_lower", "ci_upper", "n_cases", "n_controls", "maf", "mac"]


def store_results(results: DataFrame, path: str, run_id: str, phenotype_key: str) -> None:
    """Replaces the run's partition: a repeated write leaves one copy. Missing columns are null."""
    out = results.withColumns({"run_id": F.lit(run_id), "phenotype_key": F.lit(phenotype_key)})
    out = out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in RESULT_COLUMNS])
    out.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/association_result")


def create_study(spark: SparkSession, path: str, run_id: str, phenotype_key: str, method: str, n_cases: int, n_controls: int, n_variants: int, region: str = "genome-wide", notes: str = "") -> None:
    """Replaces the run's audit row."""
    row = [(run_id, f"study_{run_id}", phenotype_key, method, n_cases, n_controls, n_variants, region, notes)]
    df = spark.createDataFrame(row, "run_id string, id string, phenotype_key string, method string, n_cases long, n_controls long, n_variants_tested long, region string, notes string")
    df.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/gwas_study")


def delete_run(spark: SparkSession, path: str, run_id: str) -> int:
    """Drops the run's partitions; the number of result rows that went."""
    n = spark.read.parquet(f"{path}/association_result").where(F.col("run_id") == run_id).count()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in ("association_result", "gwas_study"):
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{t}/run_id={run_id}")
        p.getFileSystem(conf).delete(p, True)
    return n


def top_hits(results: DataFrame, variants: DataFrame, variant_gene: DataFrame, p_threshold: float = 5e-8, limit: int = 100) -> DataFrame:
    """The run's hits with position and gene set, smallest p first. The limit comes before the gene join."""
    hits = results.where(F.col("p_value") < p_threshold).join(variants, "v").orderBy("p_value", "v").limit(limit)
    named = hits.join(variant_gene.select("v", F.col("gene").alias("_g")), "v", "left")
    return named.groupBy(*hits.columns).agg(F.array_sort(F.collect_set("_g")).alias("genes")).orderBy("p_value", "v")


def manhattan(results: DataFrame, variants: DataFrame, gap: int = 1_000_000, keep_below: float = 0.05, keep_percent: int = 100, min_rows: int = 1000) -> DataFrame:
    """(v, chr, pos, x, p_value): cumulative offsets by chromosome. All rows, unless a drawing asks for fewer: with keep_percent
    below 100 that share of p >= keep_below by hash, once there are more than min_rows."""
    rows = results.select("v", "p_value").join(variants.select("v", "chr", "pos"), "v")
    spans = rows.groupBy("chr").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo") + gap).over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(spans.select("chr", "lo", before.alias("off")), "chr").select("v", "chr", "pos", (F.col("pos") - F.col("lo") + F.col("off")).alias("x"), "p_value")
    if keep_percent >= 100 or rows.count() <= min_rows:
        return out
    return out.where((F.col("p_value") < keep_below) | (F.pmod(F.xxhash64("v"), F.lit(100)) < keep_percent))


def qq(results: DataFrame) -> DataFrame:
    """(v, p_value, expected): expected (i - 0.5)/n of the i-th smallest p. Global ranks come from range partitions.

    Ranks within partitions of a sort, plus the rows of the partitions before: no task sees all rows."""
    rows = results.where("p_value IS NOT NULL").select("v", "p_value").repartitionByRange("p_value", "v").sortWithinPartitions("p_value", "v")
    placed = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    local = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("at")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    return local.join(base, "part").select("v", "p_value", ((F.col("before") + F.col("k") - 0.5) / F.col("all")).alias("expected"))


def export_tsv(results: DataFrame, path: str) -> None:
    results.orderBy("chr", "pos").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def clean_trait(name: str) -> str:
    return re.sub(r"[ -]", "_", name)


def long_phenotypes(wide: DataFrame, sample_column: str, traits: list[str] | None = None) -> DataFrame:
    """(sample_id, trait, num, str) of a wide table of strings; numbers where the cell is one."""
    traits = traits or [c for c in wide.columns if c != sample_column]
    cells = wide.select(F.col(sample_column).cast("string").alias("sample_id"), *[F.col(c).cast("string").alias(clean_trait(c)) for c in traits])
    out = cells.unpivot("sample_id", [clean_trait(c) for c in traits], "trait", "str")
    return out.where("str IS NOT NULL AND str <> ''").withColumn("num", F.expr("try_cast(str AS double)"))


def trait_summary(phenotypes: DataFrame) -> DataFrame:
    """trait, n, n_numeric, n_levels, lo, hi, mean"""
    return phenotypes.groupBy("trait").agg(F.count("*").alias("n"), F.count("num").alias("n_numeric"), F.count_distinct("str").alias("n_levels"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.avg("num").alias("mean"))


def activate(phenotypes: DataFrame, trait: str, case: str | None = None, control: str | None = None) -> DataFrame:
    """(s, is_case, y): with case and control values a binary trait (other values null), else a quantitative one."""
    rows = phenotypes.where(F.col("trait") == clean_trait(trait))
    if case is None:
        return rows.select(F.col("sample_id").alias("s"), F.lit(None).cast("boolean").alias("is_case"), F.col("num").alias("y"))
    flag: Column = F.when(F.col("str") == case, True).when(F.col("str") == control, False)
    return rows.select(F.col("sample_id").alias("s"), flag.alias("is_case"), flag.cast("double").alias("y"))


def align(samples: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """samples with covariates (s, name, value) as columns; null where there is none."""
    wide = covariates.where(F.col("name").isin(names)).groupBy("s").pivot("name", names).agg(F.first("value"))
    return samples.join(wide, "s", "left")


def check_schema(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """What is missing or empty, in words."""
    issues = []
    for name, columns in required.items():
        if name not in tables:
            issues.append(f"table {name} is missing")
            continue
        issues += [f"{name} has no column {c}" for c in columns if c not in tables[name].columns]
        if tables[name].isEmpty():
            issues.append(f"table {name} is empty")
    return issues


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


#: Functions that call any method of the JVM.
_REFLECTIVE = re.compile(r"(?i)\b(java_method|reflect|try_reflect)\b")


def _parsed(plan) -> Iterator:
    """A parsed plan's nodes, with those of its common table expressions and subqueries."""
    yield plan
    for held in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for k in range(held.size()):
            if hasattr(held.apply(k), "children"):
                yield from _parsed(held.apply(k))


def check_read_only(spark: SparkSession, query: str, tables: set[str]) -> None:
    """Raises unless the parsed query reads the named tables and its own common table expressions, and nothing else.

    Commands and writes are refused wherever they stand (FROM t INSERT ..., WITH t AS (...) INSERT ...), so are paths as
    tables, other tables and views, and functions that reflect into the JVM."""
    nodes = list(_parsed(spark._jsparkSession.sessionState().sqlParser().parsePlan(query)))
    known = {t.lower() for t in tables}
    for x in nodes:
        if x.nodeName() == "UnresolvedWith":
            known |= {x.cteRelations().apply(k)._1().lower() for k in range(x.cteRelations().size())}
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    for x in nodes:
        if command.isInstance(x) or x.nodeName().startswith("Insert"):
            raise ValueError(f"only a single SELECT is allowed, not {x.nodeName()}")
        if x.nodeName() == "UnresolvedRelation":
            name = x.multipartIdentifier()
            if name.size() != 1 or name.apply(0).lower() not in known:
                raise ValueError(f"only tables of the store can be read, not {x.tableName()}")
    if _REFLECTIVE.search(query):
        raise ValueError("functions that reflect into the JVM are not allowed")


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A read-only query over the given tables as views, its whole result; anything but one query is refused."""
    text = query.rstrip().rstrip(";")
    if ";" in text:
        raise ValueError("only a single SELECT is allowed")
    check_read_only(spark, text, set(tables))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
