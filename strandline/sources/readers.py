"""Readers and writers of the text formats that association studies exchange. All read lazily, .gz included."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.intervals import undirected
from strandline.sources.bgen_source import BGEN, BgenVariants, bgen_batches, bgen_head, readable
from strandline.sources.block_gzip import BlockGzipTable, is_block_gzip

MISSING = ("", "NA", "NaN", "nan", ".")


def number(c: str | Column) -> Column:
    """Cell to double; missing marks and other text are null."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(col.isin(*MISSING), None).otherwise(col.try_cast("double"))


def variant_id(chr: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chr{c}:{pos}:{ref}:{alt}, with one `chr` whether or not the input has it."""
    return F.concat_ws(":", F.concat(F.lit("chr"), F.regexp_replace(chr.cast("string"), "^chr", "")), pos.cast("string"), ref, alt)


def _tsv(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    return spark.read.option("header", header).option("sep", sep).option("quote", "").csv(path)


def _table(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """A tab-separated table with a header, or its rows of a region (chr, start, end) by columns chr and pos.

    `.bgz` files of blocks are read in splits, regions by the `.tbi` beside them (block_gzip.py). Those that are gzip in one
    piece, or on a file system that only Hadoop reads, come as whole values (2 GB each at most), a task for each."""
    if path.endswith(".bgz") and is_block_gzip(path):
        spark.dataSource.register(BlockGzipTable)
        reader = spark.read.format(BlockGzipTable.name())
        return (reader.option("region", "{}:{}-{}".format(*region)) if region else reader).load(path)
    raw = _whole_table(spark, path)
    if region is None:
        return raw
    return raw.where((F.regexp_replace("chr", "^chr", "") == region[0].removeprefix("chr")) & F.col("pos").cast("long").between(region[1], region[2]))


def _whole_table(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".bgz"):
        return _tsv(spark, path)

    def unpack(batches):
        for b in batches:
            for raw in b["content"]:
                lines, rest, number = [], b"", 0
                for piece in gunzipped(memoryview(raw.as_buffer())):
                    *full, rest = (rest + piece).split(b"\n")
                    lines += full
                    if len(lines) >= 50_000:
                        yield _numbered(lines, number)
                        number, lines = number + len(lines), []
                lines += [rest] if rest else []
                yield _numbered(lines, number)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "n long, line string")
    header = rows.where("n = 0").first()["line"].rstrip("\r").split("\t")
    cells = F.split(F.regexp_replace("line", "\r$", ""), "\t")
    return rows.where("n > 0 AND line <> ''").select(*[F.nullif(F.get(cells, k), F.lit("")).alias(c) for k, c in enumerate(header)])


def _numbered(lines: list[bytes], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array([x.decode() for x in lines], pa.string())], ["n", "line"])


def gunzipped(raw, step: int = 1 << 20):
    """The bytes of one gzip member after another."""
    unzip, at = zlib.decompressobj(31), 0
    while at < len(raw):
        piece = bytes(raw[at : at + step])
        at += len(piece)
        while piece:
            yield unzip.decompress(piece)
            piece = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def gtf_genes(spark: SparkSession, path: str, biotypes: tuple[str, ...] = ("protein_coding",)) -> DataFrame:
    """(gene_id, symbol, chr, start, end, strand, biotype) of gene features; versions of ids go."""
    f = F.split("value", "\t")
    attr = lambda k: F.regexp_extract(f[8], rf'\b{k} "([^"]*)"', 1)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(f[2] == "gene")
    out = rows.select(F.regexp_replace(attr("gene_id"), r"\..*$", "").alias("gene_id"), attr("gene_name").alias("symbol"), f[0].alias("chr"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"), attr("gene_type").alias("biotype"))
    return out.where(F.col("biotype").isin(*biotypes)).dropDuplicates(["gene_id"])


def gtex_eqtl(spark: SparkSession, path: str, variants: DataFrame, genes: DataFrame) -> DataFrame:
    """(variant_id, gene_id, tissue, beta, pval, slope_se, tss_distance) of significant pairs found in both tables; the
    tissue is the file's name before `.v8` or `.signif`. path may be a glob."""
    raw = _tsv(spark, path).withColumn("tissue", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.(?:v\d+|signif)", 1))
    p = F.split("variant_id", "_")
    rows = raw.select(p[0].alias("chr"), p[1].cast("long").alias("pos"), p[2].alias("ref"), p[3].alias("alt"), F.regexp_replace("gene_id", r"\..*$", "").alias("gene_id"), "tissue", number("slope").alias("beta"), number("pval_nominal").alias("pval"), number("slope_se").alias("slope_se"), number("tss_distance").cast("long").alias("tss_distance"))
    hit = rows.join(variants.select("variant_id", "chr", "pos", "ref", "alt"), ["chr", "pos", "ref", "alt"])
    return hit.join(genes.select("gene_id"), "gene_id", "left_semi").select("variant_id", "gene_id", "tissue", "beta", "pval", "slope_se", "tss_distance")


def string_ppi(spark: SparkSession, links: str, info: str, score_threshold: int = 700) -> DataFrame:
    """(a, b, score), a < b by symbol: links at the threshold, first row of each pair; self pairs go."""
    rows = _tsv(spark, links, sep=" ").select("protein1", "protein2", F.col("combined_score").cast("int").alias("score"), F.monotonically_increasing_id().alias("_k")).where(F.col("score") >= score_threshold)
    names = _tsv(spark, info)
    names = names.select(F.col(names.columns[0]).alias("p"), F.col(names.columns[1]).alias("n"))
    both = rows.join(names.select(F.col("p").alias("protein1"), F.col("n").alias("x")), "protein1").join(names.select(F.col("p").alias("protein2"), F.col("n").alias("y")), "protein2")
    return undirected(both.select("x", "y", "score", "_k"), "x", "y", "_k").select("a", "b", "score")


def encode_ccre(spark: SparkSession, path: str) -> DataFrame:
    """(id, chr, start, end, classification, category) of a BED file with 13 columns or more."""
    c = [f"_c{k}" for k in range(13)]
    raw = _tsv(spark, path, header=False)
    return raw.select(F.col(c[3]).alias("id"), F.col(c[0]).alias("chr"), F.col(c[1]).cast("long").alias("start"), F.col(c[2]).cast("long").alias("end"), F.col(c[9]).alias("classification"), F.col(c[12]).alias("category")).dropDuplicates(["id"])


def plink_glm(spark: SparkSession, path: str, p_threshold: float = 1.0) -> DataFrame:
    """Additive rows below the threshold as results on the ALT allele: linear (BETA) or logistic (OR) files."""
    raw = _tsv(spark, path)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("#")) for c in raw.columns])
    logistic = "OR" in raw.columns
    flip = F.when(F.col("A1") == F.col("ALT"), 1.0).otherwise(-1.0)
    beta = F.log(number("OR")) if logistic else number("BETA")
    se = number("LOG(OR)_SE") if "LOG(OR)_SE" in raw.columns else number("SE")
    parts = F.size(F.split("ID", ":"))
    vid = F.when(parts >= 4, F.col("ID")).otherwise(variant_id(F.col("CHROM"), F.col("POS"), F.col("REF"), F.col("ALT")))
    rows = raw.where(F.col("TEST") == "ADD") if "TEST" in raw.columns else raw
    out = rows.select(vid.alias("variant_id"), F.col("CHROM").alias("chr"), F.col("POS").cast("long").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), (beta * flip).alias("beta"), se.alias("se"), number("P").alias("p_value"), number("OBS_CT").cast("long").alias("n"))
    out = out.where(F.col("p_value") < p_threshold) if p_threshold < 1 else out.where("p_value IS NOT NULL")
    return out.withColumns({"odds_ratio": F.exp("beta") if logistic else F.lit(None).cast("double"), "p_value_log10": F.when(F.col("p_value") > 0, -F.log10("p_value")).otherwise(300.0)})


def regenie(spark: SparkSession, path: str, p_threshold: float = 1.0) -> DataFrame:
    """Rows of a white-space table with LOG10P; allele 1 is the effect allele. The header names the columns."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#"))
    names = raw.first()["value"].split()
    f = F.split(F.trim("value"), r"\s+")
    rows = raw.where(~F.col("value").startswith(names[0])).select(*[f[k].alias(n) for k, n in enumerate(names)])
    p = F.pow(F.lit(10.0), -number("LOG10P"))
    out = rows.select(variant_id(F.col("CHROM"), F.col("GENPOS"), F.col("ALLELE0"), F.col("ALLELE1")).alias("variant_id"), F.col("CHROM").alias("chr"), F.col("GENPOS").cast("long").alias("pos"), F.col("ALLELE0").alias("ref"), F.col("ALLELE1").alias("alt"), number("BETA").alias("beta"), number("SE").alias("se"), p.alias("p_value"), number("LOG10P").alias("p_value_log10"), number("A1FREQ").alias("af"))
    return out.where(F.col("p_value") < p_threshold) if p_threshold < 1 else out.where("p_value IS NOT NULL")


def panukb(spark: SparkSession, path: str, ancestry: str = "EUR", p_threshold: float | None = None, exclude_low_confidence: bool = True) -> DataFrame:
    """(chr, pos, ref, alt, beta, se, pval, neglog10p) of one ancestry; p above the threshold goes, equal stays."""
    raw = _table(spark, path)
    nl = number(f"neglog10_pval_{ancestry}")
    rows = raw.where(F.coalesce(F.lower(f"low_confidence_{ancestry}"), F.lit("")) != "true") if exclude_low_confidence else raw
    out = rows.select("chr", F.col("pos").cast("long").alias("pos"), "ref", "alt", number(f"beta_{ancestry}").alias("beta"), number(f"se_{ancestry}").alias("se"), F.pow(F.lit(10.0), -nl).alias("pval"), nl.alias("neglog10p")).dropna(subset=["beta", "se", "pval"])
    return out if p_threshold is None else out.where(F.col("pval") <= p_threshold)


def panukb_locus(spark: SparkSession, path: str, chr: str, start: int, end: int, ancestries: tuple[str, ...] = ("EUR", "CSA", "AFR", "EAS")) -> DataFrame:
    """(ancestry, variant_id, chr, pos, beta, se, z) of a region, one row for each ancestry that has numbers."""
    raw = _table(spark, path, (chr, start, end))
    held = [a for a in ancestries if f"beta_{a}" in raw.columns]
    cells = F.array(*[F.struct(F.lit(a).alias("ancestry"), number(f"beta_{a}").alias("beta"), number(f"se_{a}").alias("se")) for a in held])
    out = raw.select("chr", F.col("pos").cast("long").alias("pos"), "ref", "alt", F.explode(cells).alias("c")).select("c.ancestry", F.concat_ws(":", "chr", "pos", "ref", "alt").alias("variant_id"), "chr", "pos", "c.beta", "c.se")
    return out.dropna(subset=["beta", "se"]).where("se > 0").withColumn("z", F.col("beta") / F.col("se"))


def panukb_file_name(phenocode: str, trait_type: str, coding: str | None = None, modifier: str | None = None) -> str:
    return "-".join(x for x in (trait_type, phenocode, coding, "both_sexes", modifier) if x) + ".tsv.bgz"


def generic_sumstats(spark: SparkSession, path: str, columns: dict[str, str] | None = None, sep: str = "\t", p_threshold: float | None = None) -> DataFrame:
    """(chr, pos, ref, alt, beta, se, pval, neglog10p) by a map from our names to the file's; rows without numbers go."""
    m = {c: c for c in ("chr", "pos", "ref", "alt", "beta", "se", "pval")} | (columns or {})
    raw = _tsv(spark, path, sep=sep)
    text = lambda k: F.coalesce(F.col(m[k]), F.lit(".")) if m[k] in raw.columns else F.lit(".")
    out = raw.select(F.col(m["chr"]).alias("chr"), number(m["pos"]).cast("long").alias("pos"), text("ref").alias("ref"), text("alt").alias("alt"), *[number(m[k]).alias(k) for k in ("beta", "se", "pval")]).dropna(subset=["pos", "beta", "se", "pval"])
    out = out.withColumn("neglog10p", -F.log10(F.greatest("pval", F.lit(1e-300))))
    return out if p_threshold is None else out.where(F.col("pval") <= p_threshold)


def gene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chr, start, end, strand, id) of a headerless table; the last row of a symbol wins."""
    raw = _tsv(spark, path, header=False).withColumn("_k", F.monotonically_increasing_id())
    rows = raw.select(F.coalesce("_c5", "_c0").alias("gene"), F.struct(F.col("_c1").alias("chr"), F.col("_c2").cast("long").alias("start"), F.col("_c3").cast("long").alias("end"), F.col("_c4").alias("strand"), F.col("_c0").alias("id")).alias("r"), "_k")
    return rows.groupBy("gene").agg(F.max_by("r", "_k").alias("r")).select("gene", "r.*")


def eigenvec(spark: SparkSession, path: str, n_components: int = 10) -> DataFrame:
    """(s, name, value) of principal components: white-space table with IID and PC1.."""
    raw = spark.read.text(path)
    names = [n.lstrip("#") for n in raw.first()["value"].split()]
    f = F.split(F.trim("value"), r"\s+")
    pcs = [(n, k) for k, n in enumerate(names) if n.upper().startswith("PC")][:n_components]
    cells = F.array(*[F.struct(F.lit(f"pca_{i}").alias("name"), f[k].try_cast("double").alias("value")) for i, (_, k) in enumerate(pcs, 1)])
    rows = raw.where(~F.col("value").startswith("#") & ~F.col("value").startswith(names[0]))
    return rows.select(f[names.index("IID")].alias("s"), F.explode(cells).alias("c")).select("s", "c.name", "c.value")


def vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variants (variant_id, chr, pos, ref, alt, info) and genotypes (variant_id, sample, g), null for missing calls."""
    raw = spark.read.text(path)
    names = raw.where(F.col("value").startswith("#CHROM")).first()["value"].split("\t")[9:]
    f = F.split("value", "\t")
    rows = raw.where(~F.col("value").startswith("#")).select(f.alias("f"))
    g = F.col("f")
    vid = F.when(g[2] != ".", g[2]).otherwise(F.concat_ws(":", g[0], g[1], g[3], g[4]))
    variants = rows.select(vid.alias("variant_id"), g[0].alias("chr"), g[1].cast("long").alias("pos"), g[3].alias("ref"), g[4].alias("alt"), g[7].alias("info"))
    calls = rows.select(vid.alias("variant_id"), F.posexplode(F.slice(g, 10, len(names))).alias("k", "call"))
    gt = F.regexp_extract("call", r"^[^:]+", 0)
    dose = F.when(gt.contains("."), None).otherwise(F.length(gt) - F.length(F.translate(gt, "1", "")))
    return variants, calls.select("variant_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("sample"), dose.cast("int").alias("g"))


def graph_cache(spark: SparkSession, path: str) -> DataFrame:
    """(v, genes, pathways, ppi, prior_score) of a JSON map {variant: {genes, pathways, ppi, prior_score}}; list members are
    strings or objects with a name. The whole file is one value."""
    item = "struct<genes:array<string>,pathways:array<string>,ppi:array<string>,prior_score:double>"
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("v", "c"))
    name = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.symbol"), x))
    return rows.select("v", name(F.col("c.genes")).alias("genes"), name(F.col("c.pathways")).alias("pathways"), name(F.col("c.ppi")).alias("ppi"), "c.prior_score")


def ground_truth_edges(spark: SparkSession, path: str, species: str) -> DataFrame:
    """(a, b) of a JSON catalogue of pairs {gene_a, gene_b, species: [..]}; those that list the species."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "struct<pairs:array<struct<gene_a:string,gene_b:string,species:array<string>>>>")["pairs"]).alias("p"))
    return rows.where(F.array_contains("p.species", species)).select(F.least("p.gene_a", "p.gene_b").alias("a"), F.greatest("p.gene_a", "p.gene_b").alias("b")).distinct()


def distance_matrix(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """(i, j, d) of a square table with names in the first row and column."""
    wide = _tsv(spark, path)
    first = wide.columns[0]
    out = wide.select(F.col(first).alias("i"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in wide.columns[1:]]).unpivot("i", wide.columns[1:], "j", "d")
    return out if keep is None else out.where(F.col("i").isin(keep) & F.col("j").isin(keep))


def ld_npz(spark: SparkSession, path: str, key: str = "R", locus: str = "locus") -> DataFrame:
    """(locus, v1, v2, r, r2), v1 < v2 by index, of a locus's square matrix in a NumPy archive."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(content))) as held:
        r = held[key if key in held else held.files[0]]
    i, j = np.triu_indices(len(r), 1)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"locus": locus, "v1": i, "v2": j, "r": r[i, j], "r2": r[i, j] ** 2}))


def weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, source, w) of a table gene_a, gene_b, weight, source."""
    raw = _tsv(spark, path)
    names = {c.lower(): c for c in raw.columns}
    pick = lambda *ns: next(F.col(names[n]) for n in ns if n in names)
    return raw.select(pick("gene_a", "a").alias("a"), pick("gene_b", "b").alias("b"), pick("source").alias("source"), number(pick("weight", "w")).alias("w"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_graph_cache(df: DataFrame, path: str) -> None:
    """One JSON object for each variant and line; the readers of this module take the map form only from one file."""
    df.write.mode("overwrite").json(path)


def phenotype_manifest(spark: SparkSession, path: str, trait_type: str | None = None) -> DataFrame:
    """The manifest's rows (`.bgz` or plain), of one trait type if given."""
    raw = _table(spark, path)
    return raw if trait_type is None else raw.where(F.col("trait_type") == trait_type)


def ld_slice(ld: DataFrame, variants: DataFrame, chr: str, start: int, end: int, r2_min: float = 0.0) -> DataFrame:
    """ld (v1, v2, r) among the variants (v, chr, pos) of a region, with r2."""
    few = variants.where((F.regexp_replace(F.col("chr").cast("string"), "^chr", "") == chr.removeprefix("chr")) & F.col("pos").between(start, end)).select("v")
    out = ld.join(few.withColumnRenamed("v", "v1"), "v1", "left_semi").join(few.withColumnRenamed("v", "v2"), "v2", "left_semi")
    return out.withColumn("r2", F.col("r") * F.col("r")).where(F.col("r2") >= r2_min).select("v1", "v2", "r", "r2")


def bgen(spark: SparkSession, path: str, chr: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Variants of BGEN files (layout 2, zlib, zstandard or no compression; path may be a pattern) with all samples' dosages of
    the second allele, null where missing; variants of other than two alleles are left out.

    Files are read in splits (bgen_source.py), regions by the `.bgi` beside them. On a file system that only Hadoop reads a
    file is a value of at most 2 GB and one task; variants outside of the region are passed over without unpacking."""
    if readable(path):
        spark.dataSource.register(BgenVariants)
        options = {k: str(v) for k, v in (("chr", chr), ("start", start), ("end", end)) if v is not None}
        return spark.read.format(BgenVariants.name()).options(**options).load(path)

    def run(batches):
        for b in batches:
            for value in b["content"]:
                raw = memoryview(value.as_buffer())
                at, count, packing, ids = bgen_head(raw)
                yield from bgen_batches(raw, at, count, packing, ids, chr, start, end)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, BGEN)


def dosage_rows(variants: DataFrame, hard_calls: bool = False) -> DataFrame:
    """(v, s, g) of bgen(): the sparse form of the operators; zeros go, missing stays null. hard_calls: nearest whole dosage."""
    cells = variants.select(F.col("variant_id").alias("v"), F.explode(F.arrays_zip("sample", "dosage")).alias("c")).select("v", F.col("c.sample").alias("s"), F.col("c.dosage").cast("double").alias("g"))
    return (cells.withColumn("g", F.round("g").cast("int")) if hard_calls else cells).where("g IS NULL OR g <> 0")
