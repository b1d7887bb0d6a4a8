"""The commands: one function each over a store, a folder of Parquet tables.

Tables: genotype (v, s, g), sample (s, is_case, y, ...), variant (v, chr, pos, variant_id), gene (gene, chr, start, end),
variant_gene (v, gene, impact), gene_pathway (gene, pathway), ppi (a, b, score), phenotype (sample_id, trait, num, str),
covariate (s, name, value), trial (trial_id, genotype, environment, rep, trait, value), and the results of runs
(association_result, gwas_study). Commands return tables or dictionaries of tables and values. Anything that a command
writes goes into the store.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import assoc, epistasis, finemap, flow, gene_tests, genotype, graph_export, intervals, ld_graph, met, mr, multivariate, prs, qc, reports, store, structure, sumstats
from strandline.sources import readers

COMMANDS: dict[str, Callable] = {}
TABLES = "genotype sample variant gene variant_gene gene_pathway ppi phenotype covariate trial association_result gwas_study".split()


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def options(f: Callable) -> dict[str, tuple[type, object]]:
    """Name -> (type, default) of a command's options; a missing default means that it must be given."""
    kinds = {"str": str, "int": int, "float": float, "bool": bool}
    found = list(inspect.signature(f).parameters.values())[1:]
    return {p.name: (kinds[str(p.annotation).split(" |")[0]], p.default) for p in found}


class Store:
    """A folder of tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def __getitem__(self, name: str) -> DataFrame:
        if not self.has(name):
            raise KeyError(f"the store has no table {name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame) -> None:
        """Replaces a table, which df may be made from: written beside it first, and the old one goes once the new one has its
        place, so that at every moment one of them is whole."""
        beside = f"{self.path}/_{name}_{time.time_ns()}"
        df.write.parquet(beside)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = old.getFileSystem(conf)
        aside = jvm.org.apache.hadoop.fs.Path(f"{beside}_old")
        if fs.exists(old) and not fs.rename(old, aside):
            raise OSError(f"{name} could not be put aside")
        if not fs.rename(new, old):
            fs.rename(aside, old)
            raise OSError(f"{beside} could not take the place of {name}")
        fs.delete(aside, True)

    def region(self, chr: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        v = self["variant"]
        if chr is not None:
            v = v.where(F.regexp_replace(F.col("chr").cast("string"), "^chr", "") == chr.removeprefix("chr"))
        if start is not None:
            v = v.where(F.col("pos") >= start)
        return v if end is None else v.where(F.col("pos") <= end)

    def genotypes(self, *region) -> DataFrame:
        g = self["genotype"]
        return g.join(self.region(*region).select("v"), "v", "left_semi") if any(x is not None for x in region) else g

    def n(self) -> int:
        return self["sample"].count()

    def results(self, run_id: str) -> DataFrame:
        """A run's rows with v, chr, pos, chi2."""
        rows = self["association_result"].where(F.col("run_id") == run_id)
        out = rows.join(self["variant"].select("v", "variant_id", "chr", "pos"), "variant_id")
        return out.withColumn("chi2", F.when(F.col("se") > 0, F.pow(F.col("beta") / F.col("se"), 2)))

    def ld(self, *region, window: int = 100_000) -> DataFrame:
        return genotype.ld_pairs(self.genotypes(*region), self.region(*region), self.n(), window)

    def vg(self) -> DataFrame:
        return self["variant_gene"].select("v", "gene")

    def vp(self) -> DataFrame:
        return self.vg().join(self["gene_pathway"], "gene").select("v", "pathway").distinct()

    def trial(self, trial_id: str, trait: str) -> DataFrame:
        return self["trial"].where((F.col("trial_id") == trial_id) & (F.col("trait") == trait))

    def save(self, results: DataFrame, method: str, phenotype: str = "active") -> str:
        run = f"{method}_{time.time_ns()}"
        store.store_results(results.drop("variant_id").join(self["variant"].select("v", "variant_id"), "v"), self.path, run, phenotype)
        n = self["sample"].agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b")).first()
        store.create_study(self.spark, self.path, run, phenotype, method, n["a"], n["b"], results.count())
        return run


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


@command("status")
def status(s: Store):
    held = {t: s[t] for t in TABLES if s.has(t)}
    return {"tables": store.audit(held) if held else None, "issues": store.check_schema(held, {"genotype": ["v", "s", "g"], "sample": ["s", "is_case", "y"], "variant": ["v", "chr", "pos"]})}


@command("ensure-indexes")
def ensure_indexes(s: Store):
    """Tables laid out by the columns that commands look up: variants by place, genotypes by variant."""
    s.put("variant", s["variant"].repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos"))
    s.put("genotype", s["genotype"].repartitionByRange("v").sortWithinPartitions("v", "s"))
    return status(s)


@command("phenotype load")
def phenotype_load(s: Store, phenotype_file: str, sample_id_col: str = "sample_id", traits: str | None = None):
    """Adds a CSV's traits, replacing those of the same name; counts of samples found and not found."""
    wide = s.spark.read.option("header", True).csv(phenotype_file)
    rows = store.long_phenotypes(wide, sample_id_col, names(traits) if traits else None)
    known = s["sample"].select(F.col("s").cast("string").alias("sample_id"))
    found = rows.join(known, "sample_id", "left_semi")
    ids = rows.select("sample_id").distinct()
    counts = {"matched": ids.join(known, "sample_id", "left_semi").count(), "unmatched": ids.join(known, "sample_id", "left_anti").count()}
    if s.has("phenotype"):
        found = s["phenotype"].join(found.select("trait").distinct(), "trait", "left_anti").unionByName(found)
    s.put("phenotype", found)
    return counts | {"traits": store.trait_summary(s["phenotype"])}


@command("phenotype activate")
def phenotype_activate(s: Store, trait: str, case_value: str | None = None, control_value: str | None = None):
    active = store.activate(s["phenotype"], trait, case_value, control_value)
    old = s["sample"].drop("is_case", "y")
    s.put("sample", old.join(active.select(F.col("s").cast(old.schema["s"].dataType).alias("s"), "is_case", "y"), "s", "left"))
    return s["sample"].agg(F.count_if("is_case").alias("n_cases"), F.count_if(~F.col("is_case")).alias("n_controls"), F.count("y").alias("n_values"))


@command("phenotype clear")
def phenotype_clear(s: Store):
    s.put("sample", s["sample"].withColumns({"is_case": F.lit(None).cast("boolean"), "y": F.lit(None).cast("double")}))
    return {"cleared": True}


@command("phenotype simulated")
def phenotype_simulated(s: Store, trait: str, effects: str, h2: float = 0.1, seed: int = 42):
    """A simulated quantitative trait (effects: `variant=beta,...`) stored as a phenotype."""
    from strandline.operators.simulate import causal

    kind = dict(s["variant"].dtypes)["v"]
    chosen = {(int(k) if kind in ("int", "bigint") else k): float(b) for k, b in (x.split("=") for x in names(effects))}
    made = causal(s["genotype"], s["sample"], chosen, h2, seed)
    rows = made.select(F.col("s").cast("string").alias("sample_id"), F.lit(store.clean_trait(trait)).alias("trait"), F.col("y").cast("string").alias("str"), F.col("y").alias("num"))
    if s.has("phenotype"):
        rows = s["phenotype"].where(F.col("trait") != store.clean_trait(trait)).unionByName(rows)
    s.put("phenotype", rows)
    return store.trait_summary(s["phenotype"])


@command("genes load")
def genes_load(s: Store, gtf: str):
    """Protein-coding genes of a GTF, merged into the gene table by id."""
    new = readers.gtf_genes(s.spark, gtf).select(F.col("gene_id").alias("gene"), "symbol", "chr", "start", "end")
    if s.has("gene"):
        new = s["gene"].join(new.select("gene"), "gene", "left_anti").unionByName(new, allowMissingColumns=True)
    s.put("gene", new)
    return {"genes": s["gene"].count()}


@command("import-pca")
def import_pca(s: Store, eigenvec_file: str, n_components: int = 10):
    rows = readers.eigenvec(s.spark, eigenvec_file, n_components).select(F.col("s").cast("string").alias("s"), "name", "value")
    if s.has("covariate"):
        rows = s["covariate"].join(rows.select("name").distinct(), "name", "left_anti").unionByName(rows)
    s.put("covariate", rows)
    return s["covariate"].groupBy("name").agg(F.count("*").alias("n"))


@command("qc run")
def qc_run(s: Store, chromosomes: str | None = None):
    g = s["genotype"]
    if chromosomes:
        g = g.join(s["variant"].where(F.col("chr").cast("string").isin(names(chromosomes))).select("v"), "v", "left_semi")
    return {"variants": qc.variant_qc(g, s["sample"]), "samples": qc.sample_qc(g, s["sample"], s["variant"].count())}


@command("assoc scan")
def assoc_scan(s: Store, chr: str | None = None, start: int | None = None, end: int | None = None, method: str = "auto", covariates: str | None = None, store_results: bool = False):
    """Scan of a region: linear for a quantitative trait, else by variant; covariates by name from the covariate table."""
    g, people = s.genotypes(chr, start, end), s["sample"]
    if covariates:
        held = s["covariate"].select(F.col("s").cast(people.schema["s"].dataType).alias("s"), "name", "value")
        people = store.align(people, held, names(covariates))
    if people.where("is_case IS NOT NULL").isEmpty():
        out = assoc.linear_scan_adjusted(g, people, names(covariates)) if covariates else assoc.linear_scan(g, people)
    elif covariates:
        out = assoc.logistic_scan_adjusted(g, people, names(covariates), firth=method != "logistic")
    else:
        out = assoc.single_locus_scan(g, people, method)
    out = out.join(s["variant"].select("v", "variant_id", "chr", "pos"), "v")
    return {"run_id": s.save(out, f"scan-{method}"), "results": out} if store_results else out


@command("assoc mpat")
def assoc_mpat(s: Store, chr: str | None = None, genes: str | None = None, method: str = "directed", min_variants: int = 2):
    z = assoc.variant_z(s.genotypes(chr, None, None), s["sample"]).join(s.vg(), "v").select("gene", "v", "z")
    if genes:
        z = z.where(F.col("gene").cast("string").isin(names(genes)))
    test = {"directed": gene_tests.directed, "undirected": gene_tests.undirected}[method]
    return test(z, s.ld(chr, None, None).select("v1", "v2", "r"), min_variants)


@command("assoc top-hits")
def top_hits(s: Store, run_id: str, p_threshold: float = 5e-8, limit: int = 100):
    r = s.results(run_id)
    return store.top_hits(r.select("v", "beta", "se", "p_value"), s["variant"], s.vg(), p_threshold, limit)


@command("gene-counts")
def gene_counts(s: Store):
    af = structure.allele_frequencies(s["genotype"], s.n())
    return intervals.gene_counts(s["variant_gene"].join(af, "v"))


@command("plot manhattan")
def plot_manhattan(s: Store, run_id: str):
    return store.manhattan(s.results(run_id), s["variant"])


@command("plot qq")
def plot_qq(s: Store, run_id: str):
    r = s.results(run_id)
    return {"points": store.qq(r), "lambda_gc": assoc.lambda_gc(r)}


@command("results show")
def results_show(s: Store, run_id: str):
    return s.results(run_id)


@command("results export")
def results_export(s: Store, run_id: str, output: str):
    store.export_tsv(s.results(run_id), output)
    return {"written": output}


@command("results delete")
def results_delete(s: Store, run_id: str):
    return {"deleted": store.delete_run(s.spark, s.path, run_id)}


@command("interpret")
def interpret(s: Store, run_id: str):
    r = s.results(run_id)
    rows = r.select("chr", "pos", "v", "beta", "se", F.col("p_value").alias("pval"))
    return {"summary": sumstats.interpret(r), "leads": sumstats.clump(sumstats.significant(rows))}


@command("popstruct spectral-pcs")
def spectral_pcs(s: Store, n_components: int = 20, af_threshold: float = 0.05):
    return reports.spectral_components(s["genotype"], s["sample"], af_threshold, n_components)


@command("popstruct grammar")
def grammar(s: Store, trait: str | None = None, n_pcs: int = 10):
    people = s["sample"]
    if trait:
        active = store.activate(s["phenotype"], trait).select(F.col("s").cast(people.schema["s"].dataType).alias("s"), "y")
        people = people.drop("y").join(active, "s", "left")
    out, info = structure.corrected_scan(s["genotype"], people, "mixed+", n_pcs)
    return info | {"results": out}


@command("epistasis scan")
def epistasis_scan(s: Store, chr: str | None = None, start: int | None = None, end: int | None = None, window: int = 1_000_000, min_cocarriers: int = 3, min_enrichment: float = 1.5, permutations: int = 1000):
    """Windows of co-occurrence, Louvain modules of each chromosome, and their permutation tests."""
    g, v = s.genotypes(chr, start, end), s.region(chr, start, end)
    edges = epistasis.cooccurrence(g, s["sample"], v, window, min_cocarriers, min_enrichment)
    parts = epistasis.modules(edges.join(v.select(F.col("v").alias("v1"), "chr"), "v1"))
    members = parts.select("v", F.concat_ws(":", F.col("chr").cast("string"), F.col("module").cast("string")).alias("module"))
    return {"edges": edges, "modules": parts, "tests": epistasis.module_permutation(g, s["sample"], members, permutations)}


@command("flow architecture")
def flow_architecture(s: Store, chr: str | None = None, af_threshold: float = 0.05, permutations: int = 100, p_threshold: float = 0.05):
    tested = flow.test_flows(s.genotypes(chr, None, None), s["sample"], s["variant_gene"], s["gene_pathway"], af_threshold, permutations)
    return {"pathways": tested, "architecture": flow.architecture(tested, p_threshold)}


@command("finemap")
def finemap_locus(s: Store, chr: str, start: int, end: int, r2_threshold: float = 0.3, method: str = "betweenness"):
    ld = s.ld(chr, start, end, window=end - start + 1).withColumn("locus", F.lit(f"{chr}:{start}-{end}"))
    return ld_graph.centrality(ld_graph.ld_graph(ld, r2_threshold), method)


def fine_map(spark: SparkSession, candidates: DataFrame, ld: DataFrame, annotations: DataFrame, n_samples: int, method: str, lambda_gc: float | None, alpha: float, coverage: float) -> DataFrame:
    if method == "gafm":
        return finemap.gafm(candidates.withColumn("z", finemap.deflate(F.col("z"), lambda_gc)), ld, alpha, coverage=coverage)
    if method == "hbp":
        return finemap.hbp(candidates.withColumn("z", finemap.deflate(F.col("z"), lambda_gc)), ld, annotations, alpha=alpha, coverage=coverage)
    one = lambda: finemap.gafm_mx(candidates, ld, n_samples, coverage=coverage, lambda_gc=lambda_gc)
    other = lambda: finemap.hbp_mx(candidates, ld, annotations, n_samples, coverage, lambda_gc)
    if method not in ("gafm-mx", "hbp-mx", "ens"):
        raise ValueError(f"method {method}: gafm, hbp, gafm-mx, hbp-mx or ens")
    return one() if method == "gafm-mx" else other() if method == "hbp-mx" else finemap.ensemble(one(), other(), coverage=coverage)


@command("finemap-sumstats")
def finemap_sumstats(s: Store, variants_tsv: str, z_tsv: str, ld_npz: str, n_samples: int, method: str = "ens", lambda_gc: float | None = None, alpha: float = 0.6, coverage: float = 0.95, graph_cache: str | None = None, out_tsv: str | None = None):
    """Fine-mapping from files: variants (variant_id, ...), z (variant_id, z), squared correlations (R_sq) in file order."""
    read = lambda p: s.spark.read.option("header", True).option("sep", "\t").csv(p)
    order = {r["variant_id"]: k for k, r in enumerate(read(variants_tsv).select("variant_id").collect())}  # one locus
    place = s.spark.createDataFrame(list(order.items()), "variant_id string, v long")
    z = read(z_tsv).select("variant_id", F.abs(F.col("z").cast("double")).alias("z")).join(place, "variant_id")
    candidates = z.select(F.lit("locus").alias("locus"), "v", "z")
    ld = readers.ld_npz(s.spark, ld_npz, "R_sq").select("locus", "v1", "v2", F.col("r").alias("r2"))
    none = "v long, genes array<string>, pathways array<string>, ppi array<string>"
    notes = s.spark.createDataFrame([], none)
    if graph_cache:
        notes = readers.graph_cache(s.spark, graph_cache).withColumnRenamed("v", "variant_id").join(place, "variant_id").drop("variant_id")
    found = fine_map(s.spark, candidates, ld, notes, n_samples, method, lambda_gc, alpha, coverage)
    out = found.join(place, "v").select("variant_id", "pip", "in_credible_set", F.row_number().over(finemap.locus().orderBy(F.desc("pip"), "v")).alias("rank"))
    if out_tsv:
        readers.write_tsv(out.coalesce(1).sortWithinPartitions("rank"), out_tsv)
    return out


@command("spectral correction")
def spectral_correction(s: Store, n_components: int = 10, af_threshold: float = 0.01, chr: str | None = None):
    """(s, y, smooth, residual): the trait's part on the first eigenvectors of the rare-variant graph, and the rest."""
    people = s["sample"]
    ids, _, vectors = reports.spectrum_of(s.genotypes(chr, None, None), people, af_threshold, n_components)
    y = reports.trait_on(ids, people)
    smooth = structure.smooth_signal(y - y.mean(), vectors, n_components)
    rows = [(i.item() if isinstance(i, np.generic) else i, float(a), float(b), float(a - y.mean() - b)) for i, a, b in zip(ids, y, smooth, strict=True)]
    return s.spark.createDataFrame(rows, f"s {people.schema['s'].dataType.simpleString()}, y double, smooth double, residual double")


@command("gnn export")
def gnn_export(s: Store, chr: str | None = None, start: int | None = None, end: int | None = None, output: str | None = None, max_variants: int = 10_000):
    made = graph_export.export(s.genotypes(chr, start, end), s["sample"], s.region(chr, start, end), s.vg(), max_variants=max_variants)
    for name, df in made.items() if output else ():
        df.write.mode("overwrite").parquet(f"{output}/{name}")
    return made


@command("gnn run")
def gnn_run(s: Store, chr: str | None = None, start: int | None = None, end: int | None = None, max_variants: int = 10_000):
    """The linear model over neighbour features that stands in for a graph network, and its area under the curve."""
    made = graph_export.export(s.genotypes(chr, start, end), s["sample"], s.region(chr, start, end), s.vg(), max_variants=max_variants)
    scored = graph_export.linear_substitute(graph_export.neighbour_features(made))
    return {"scores": scored, "auroc": prs.auroc(scored)}


@command("heritability spectral")
def heritability_spectral(s: Store, af_threshold: float = 0.01, n_components: int = 20, chr: str | None = None):
    ids, values, vectors = reports.spectrum_of(s.genotypes(chr, None, None), s["sample"], af_threshold, n_components)
    return structure.spectral_heritability(values, vectors, reports.trait_on(ids, s["sample"]))


@command("heritability conductance")
def heritability_conductance(s: Store, af_threshold: float = 0.01, chr: str | None = None, permutations: int = 200):
    return structure.conductance_heritability(s.genotypes(chr, None, None), s["sample"], af_threshold, permutations)


@command("heritability flow")
def heritability_flow(s: Store, chr: str | None = None, af_threshold: float = 0.05, permutations: int = 100):
    return flow.heritability(s.genotypes(chr, None, None), s["sample"], s["variant_gene"], s["gene_pathway"], af_threshold, permutations)


@command("heritability gnn")
def heritability_gnn(s: Store, chr: str | None = None, start: int | None = None, end: int | None = None, prevalence: float = 0.1):
    """Liability-scale heritability from the area under the curve of the linear model over neighbour features."""
    row = gnn_run(s, chr, start, end)["auroc"].first()
    return {"auroc": row["auroc"], "h2": structure.liability_h2(row["auroc"], prevalence)}


@command("heritability multi")
def heritability_multi(s: Store, n_components: int = 20, af_threshold: float = 0.01):
    out = reports.heritability(s["genotype"], s["sample"], s.vg(), s["gene_pathway"], af_threshold, n_components)
    return {"h2": out["h2"], "shares": out["shares"]}


@command("heritability report")
def heritability_report(s: Store, n_components: int = 20, af_threshold: float = 0.01):
    return reports.heritability(s["genotype"], s["sample"], s.vg(), s["gene_pathway"], af_threshold, n_components) | {"flow": heritability_flow(s)}


def with_traits(s: Store, *traits: str) -> DataFrame:
    wide = multivariate.complete_traits(s["phenotype"], [store.clean_trait(t) for t in traits])
    return wide.select(F.col("s").cast(s["sample"].schema["s"].dataType).alias("s"), *wide.columns[1:])


@command("multivariate correlation")
def multivariate_correlation(s: Store, trait1: str, trait2: str, af_threshold: float = 0.01, n_components: int = 20):
    pair = [store.clean_trait(t) for t in (trait1, trait2)]
    return reports.bivariate(s["genotype"], with_traits(s, *pair), pair, af_threshold, n_components)["pair"]


@command("multivariate g-matrix")
def multivariate_g_matrix(s: Store, traits: str, af_threshold: float = 0.01, n_components: int = 20):
    each = [store.clean_trait(t) for t in names(traits)]
    out = reports.bivariate(s["genotype"], with_traits(s, *each), each, af_threshold, n_components)
    return {"names": out["names"], "g": out["g"].tolist(), "r_g": out["r_g"].tolist()}


@command("multivariate multi-resolution")
def multivariate_multi(s: Store, trait1: str, trait2: str, af_threshold: float = 0.01):
    pair = tuple(store.clean_trait(t) for t in (trait1, trait2))
    return reports.multiresolution_correlation(s["genotype"], with_traits(s, *pair), pair, s.vg(), s["gene_pathway"], af_threshold)


@command("multivariate coherence")
def multivariate_coherence(s: Store, trait1: str, trait2: str, af_threshold: float = 0.01, n_components: int = 20):
    pair = [store.clean_trait(t) for t in (trait1, trait2)]
    people = with_traits(s, *pair)
    ids, values, vectors = reports.spectrum_of(s["genotype"], people, af_threshold, n_components)
    c1, c2 = multivariate.spectrum(vectors, *(reports.trait_on(ids, people, t) for t in pair))
    rows = [(k, float(v), float(a), float(b)) for k, (v, a, b) in enumerate(zip(values, c1, c2, strict=True))]
    return multivariate.coherence(s.spark.createDataFrame(rows, "component int, value double, c1 double, c2 double"))


@command("multivariate pleiotropy")
def multivariate_pleiotropy(s: Store, run1: str, run2: str, p_threshold: float = 5e-8):
    return multivariate.pleiotropic_genes(s.results(run1), s.results(run2), s.vg(), p_threshold)


@command("multivariate psi")
def multivariate_psi(s: Store, run_ids: str, p_threshold: float = 5e-8):
    runs = s["association_result"].where(F.col("run_id").isin(names(run_ids))).join(s["variant"].select("v", "variant_id"), "variant_id")
    return multivariate.pleiotropy_score(runs.select("run_id", "v", "p_value"), s.vg(), p_threshold)


@command("multivariate report")
def multivariate_report(s: Store, trait1: str, trait2: str, af_threshold: float = 0.01):
    return {"covariance": multivariate_correlation(s, trait1, trait2, af_threshold), "coherence": multivariate_coherence(s, trait1, trait2, af_threshold)}


@command("met load")
def met_load(s: Store, csv: str, genotype_col: str, env_col: str, traits: str, rep_col: str | None = None, trial_id: str = "trial"):
    wide = s.spark.read.option("header", True).csv(csv)
    each = names(traits)
    rep = F.col(rep_col).cast("int") if rep_col else F.lit(1)
    rows = wide.select(F.lit(trial_id).alias("trial_id"), F.col(genotype_col).alias("genotype"), F.col(env_col).alias("environment"), rep.alias("rep"), *[F.col(t).try_cast("double").alias(t) for t in each])
    rows = rows.unpivot(["trial_id", "genotype", "environment", "rep"], each, "trait", "value")
    if s.has("trial"):
        rows = s["trial"].where(F.col("trial_id") != trial_id).unionByName(rows)
    s.put("trial", rows)
    return met_status(s, trial_id)


@command("met status")
def met_status(s: Store, trial_id: str = "trial"):
    return s["trial"].where(F.col("trial_id") == trial_id).groupBy("trait").agg(F.count("value").alias("n"), F.count_distinct("genotype").alias("n_genotypes"), F.count_distinct("environment").alias("n_environments"))


@command("met env-similarity")
def met_similarity(s: Store, trait: str, trial_id: str = "trial"):
    return met.environment_similarity(s.trial(trial_id, trait))


@command("met mega-env")
def met_mega(s: Store, trait: str, trial_id: str = "trial"):
    return met.mega_environments(s.trial(trial_id, trait))


@command("met gxe")
def met_gxe(s: Store, trait: str, trial_id: str = "trial"):
    return met.gxe(s.trial(trial_id, trait))


@command("met diagnostics")
def met_diagnostics(s: Store, trait: str | None = None, trial_id: str = "trial"):
    rows = s["trial"].where(F.col("trial_id") == trial_id)
    return met.design(rows if trait is None else rows.where(F.col("trait") == trait))


@command("met reaction-norm")
def met_reaction(s: Store, trait: str, trial_id: str = "trial", top_n: int = 100):
    """Reaction norms of the variants' effects, each environment scanned by itself."""
    means, effects = met.cell_means(s.trial(trial_id, trait)), None
    kind = s["sample"].schema["s"].dataType
    for (env,) in means.select("environment").distinct().orderBy("environment").collect():  # environments are few
        y = means.where(F.col("environment") == env).select(F.col("genotype").cast(kind).alias("s"), F.col("m").alias("y"))
        one = assoc.linear_scan(s["genotype"], y).select("v", F.lit(env).alias("environment"), "beta")
        effects = one if effects is None else effects.union(one)
    return met.reaction_norms(effects, top_n=top_n)


@command("met impute")
def met_impute(s: Store, trait: str, genotype: str, environment: str, trial_id: str = "trial", k_neighbors: int = 10):
    return met.impute(s.trial(trial_id, trait), genotype, environment, k_neighbors)


@command("met report")
def met_report(s: Store, trait: str, trial_id: str = "trial"):
    return reports.trial(s.trial(trial_id, trait))


def run_weights(s: Store, run_id: str) -> DataFrame:
    return s.results(run_id).select("v", "beta", "p_value")


@command("prs classical")
def prs_classical(s: Store, run_id: str, p_threshold: float = 5e-8):
    return prs.classical(s["genotype"], run_weights(s, run_id), s["sample"], p_threshold)


@command("prs graph-pruned")
def prs_pruned(s: Store, run_id: str, p_threshold: float = 5e-8, r2_threshold: float = 0.2, method: str = "centrality"):
    kept = prs.prune(run_weights(s, run_id), s.ld(), p_threshold, r2_threshold, method)
    return {"weights": kept, "scores": prs.classical(s["genotype"], kept, s["sample"], p_threshold)}


@command("prs pathway")
def prs_pathway(s: Store, run_id: str, p_threshold: float = 1e-5):
    scores = prs.by_pathway(s["genotype"], run_weights(s, run_id), s.vp(), p_threshold)
    return {"scores": scores, "effects": prs.pathway_effects(scores, s["sample"])}


@command("prs report")
def prs_report(s: Store, run_id: str, p_threshold: float = 5e-8):
    return reports.scores(s["genotype"], s["sample"], run_weights(s, run_id), s.ld(), s.vp(), p_threshold)


@command("mr report")
def mr_report(s: Store, exposure_run: str, outcome_run: str, p_threshold: float = 5e-8):
    e, o = (s.results(r).select("v", "chr", "beta", "se", "p_value") for r in (exposure_run, outcome_run))
    some = mr.select_instruments(e, o.drop("chr"), s.ld(), p_threshold)
    return mr.report(some) | {"pleiotropy": mr.pleiotropy_classes(some, s.vp()), "by_pathway": mr.by_pathway(some, s.vp())}


@command("sql")
def sql(s: Store, query: str):
    """A single SELECT over the store's tables."""
    return store.run_sql(s.spark, query, {t: s[t] for t in TABLES if s.has(t)})
