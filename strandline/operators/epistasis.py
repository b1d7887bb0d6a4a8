"""Interaction scans. genotypes: sparse (v, s, g); samples: (s, is_case, y); variants: (v, chr, pos)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline.functions.special import fisher_p, poisson_p, rounded_to, t_p
from strandline.operators.genotype import ld_pairs
from strandline.operators.graph import adjacency, louvain
from strandline.operators.lineage import cut, md5_number, written
from strandline.operators.tiles import pair_products


#: Parts of a pathway's pairs.
PARTS = 16


def sliding_windows(variants: DataFrame, size: int = 1_000_000, step: int = 500_000) -> DataFrame:
    """(window, chr, start, v, pos): each variant in every window [start, start + size) on multiples of step."""
    first = F.greatest(F.floor((F.col("pos") - size) / step) + 1, F.lit(0))
    starts = F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("k")
    out = variants.select("v", "chr", "pos", starts).withColumn("start", F.col("k") * step)
    return out.select(F.concat_ws(":", "chr", "start").alias("window"), "chr", "start", "v", "pos")


def carrier_pairs(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v1, v2, co_case, co_ctrl): shared carriers of given pairs, counted in pairs of tiles of variants.

    Pairs without a shared carrier have no row."""
    known = samples.where("is_case IS NOT NULL").select("s", "is_case")
    c = genotypes.where("g > 0").join(known, "s")
    values = {"case": F.col("is_case").cast("tinyint"), "ctrl": (~F.col("is_case")).cast("tinyint")}
    counts = pair_products(pairs.select("v1", "v2").distinct(), c, values, {"co_case": ("case", "case"), "co_ctrl": ("ctrl", "ctrl")})
    return counts.select("v1", "v2", *[F.col(c).cast("long").alias(c) for c in ("co_case", "co_ctrl")])


def window_pairs(variants: DataFrame, size: int, min_distance: int = 0) -> DataFrame:
    """(v1, v2), v1 < v2, on a chromosome at most size and at least min_distance apart, by neighbouring bins."""
    place = variants.select("v", "chr", "pos", F.floor(F.col("pos") / size).alias("bin"))
    a = place.select(F.col("v").alias("v1"), "chr", F.col("pos").alias("p1"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = place.select(F.col("v").alias("v2"), "chr", F.col("pos").alias("p2"), "bin")
    gap = F.abs(F.col("p1") - F.col("p2"))
    return a.join(b, ["chr", "bin"]).where((F.col("v1") < F.col("v2")) & (gap <= size) & (gap >= min_distance)).select("v1", "v2", "chr", "p1", "p2")


def _sizes(samples: DataFrame) -> tuple[int, int]:
    r = samples.agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b")).first()
    return r["a"], r["b"]


def cooccurrence(genotypes: DataFrame, samples: DataFrame, variants: DataFrame, window: int = 1_000_000, min_cocarriers: int = 3, min_enrichment: float = 1.5) -> DataFrame:
    """(v1, v2, co_case, co_ctrl, enrichment): carried together in cases more than in controls."""
    n_case, n_ctrl = _sizes(samples)
    few = genotypes.where("g > 0").join(samples.where("is_case").select("s"), "s").groupBy("v").agg(F.count("*").alias("k")).where(F.col("k") >= min_cocarriers)
    pairs = window_pairs(variants.join(few, "v", "left_semi"), window)
    counts = carrier_pairs(genotypes, samples, pairs).where(F.col("co_case") >= min_cocarriers)
    rate = (F.col("co_case") / n_case) / (F.col("co_ctrl") / n_ctrl + 0.5 / n_ctrl)
    return counts.withColumn("enrichment", rate).where(F.col("enrichment") >= min_enrichment)


def modules(edges: DataFrame, by: str = "chr", resolution: float = 1.0, min_size: int = 2) -> DataFrame:
    """(by, module, v): Louvain communities of enrichment in each group."""
    kind = edges.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pd.Series(louvain(adjacency(pdf[["v1", "v2", "enrichment"]].itertuples(index=False)), resolution))
        sizes = part.map(part.value_counts())
        part = part[sizes >= min_size]
        return pd.DataFrame({by: pdf[by].iloc[0], "module": part.to_numpy(), "v": part.index})

    return edges.groupBy(by).applyInPandas(run, f"{by} {kind}, module long, v long")


#: Labels of recent numbers of carriers, in a worker.
_HELD: dict = {}


def _labels(seed: int, n_case: int, n_ctrl: int, carriers: int, start: int, end: int) -> np.ndarray:
    """(draws, carriers): carriers' labels under permutations of all samples: how many cases fall on carriers, then which."""
    key = (seed, n_case, n_ctrl, carriers, start, end)
    if key not in _HELD:
        if len(_HELD) >= 192:
            _HELD.pop(next(iter(_HELD)))
        out = np.zeros((end - start, carriers), bool)
        for k in range(start, end):
            rng = np.random.default_rng([seed, k])
            among = rng.hypergeometric(n_case, n_ctrl, carriers)
            out[k - start, rng.permutation(carriers)[:among]] = True
        _HELD[key] = out
    return _HELD[key]


def module_permutation(genotypes: DataFrame, samples: DataFrame, members: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(module, score, p_value): mean pairwise enrichment against permuted case labels; p = (hits + 1) / (draws + 1).

    A module's carriers are one group; each draw has its own seed. The labels of a draw depend on the number of carriers
    alone, so a worker keeps those of recent numbers, and a module's draws are counted in products of matrices."""
    n_case, n_ctrl = _sizes(samples)
    rows = genotypes.where("g > 0").join(members, "v").join(samples.where("is_case IS NOT NULL").select("s", "is_case"), "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        who, vs = pd.factorize(pdf["s"])[0], pd.factorize(pdf["v"])[0]
        m = np.zeros((vs.max() + 1, who.max() + 1), np.float32)  # counts of samples are exact below 2^24
        m[vs, who] = 1
        case = np.zeros((1, who.max() + 1), bool)
        case[0, who] = pdf["is_case"].to_numpy(bool)
        one, two = np.triu_indices(len(m), 1)
        n = case.shape[1]

        def scores(c: np.ndarray) -> np.ndarray:
            if not len(one):
                return np.zeros(len(c))
            out = np.zeros((len(c), len(one)))
            for at in range(0, len(one), 256):
                both = m[one[at : at + 256]] * m[two[at : at + 256]]
                a = (c.astype(np.float32) @ both.T).astype(float)
                out[:, at : at + 256] = (a / n_case) / ((both.sum(1, dtype=float) - a) / n_ctrl + 0.5 / n_ctrl)
            return out.mean(1)

        step = int(max(1, min(draws, 1_000_000 // max(n, len(one), 1))))  # bounded, also for many carriers or pairs
        seen = scores(case)[0]
        hits = sum(int((scores(_labels(seed, n_case, n_ctrl, n, k, min(k + step, draws))) >= seen).sum()) for k in range(0, draws, step))
        return pd.DataFrame({"module": [pdf["module"].iloc[0]], "score": [seen], "p_value": [(hits + 1) / (draws + 1)]})

    return rows.groupBy("module").applyInPandas(run, f"module {members.schema['module'].dataType.simpleString()}, score double, p_value double")


def interaction_moments(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, covariates: tuple[str, ...] = ()) -> DataFrame:
    """Sums of 1, covariates, g1, g2, g1 g2 and y for given pairs over samples with a trait and all covariates; absent
    genotypes are 0. What both variants carry is summed in pairs of tiles; the rest are sums of a variant or of the samples."""
    cs = [f"c{k}" for k in range(len(covariates))]
    known = samples.dropna(subset=["y", *covariates]).select("s", "y", *[F.col(c).cast("double").alias(n) for c, n in zip(covariates, cs, strict=True)])
    plain = ["y", *cs]
    n = known.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in plain], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(plain) for b in plain[i:]]).first()
    rows = written(genotypes.where("g > 0").join(known, "s").withColumn("g", F.col("g").cast("double")).select("v", "s", "g", *plain))
    one = rows.groupBy("v").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("gg"), *[F.sum(F.col("g") * F.col(c)).alias(f"g{c}") for c in plain])
    g = F.col("g")
    values = {"g": g, "q": g * g} | {f"g{c}": g * F.col(c) for c in plain}
    sums = {"x": ("g", "g"), "xx": ("q", "q"), "xg1": ("q", "g"), "xg2": ("g", "q")} | {f"x{c}": ("g" + c, "g") for c in plain}
    both = pair_products(pairs.select("v1", "v2").distinct(), rows, values, sums).where("x > 0")
    for k in ("1", "2"):
        both = both.join(one.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("g", "gg", *[f"g{c}" for c in plain])]), f"v{k}")
    return both.withColumns({c: F.lit(float(n[c] or 0.0) if c != "n" else n[c]) for c in n.asDict()})


def _interaction_fit(covariates: int):
    """y on 1, covariates, g1, g2 and their product from the sums: all systems at once; singular or below 20 samples: zeros."""
    cs = [f"c{k}" for k in range(covariates)]

    def cross(a: str, b: str) -> str:
        """The column that holds the sum of a times b."""
        known = {("1", "1"): "n", ("1", "g1"): "g_1", ("1", "g2"): "g_2", ("1", "x"): "x", ("g1", "g1"): "gg_1", ("g2", "g2"): "gg_2", ("g1", "g2"): "x", ("g1", "x"): "xg1", ("g2", "x"): "xg2", ("x", "x"): "xx", ("1", "y"): "y", ("g1", "y"): "gy_1", ("g2", "y"): "gy_2", ("x", "y"): "xy"}
        for c in cs:
            known |= {("1", c): c, (c, "g1"): f"g{c}_1", (c, "g2"): f"g{c}_2", (c, "x"): f"x{c}", (c, "y"): f"y{c}"}
        known |= {(a, b): f"{a}{b}" for i, a in enumerate(cs) for b in cs[i:]}
        return known.get((a, b)) or known[b, a]

    terms = ["1", *cs, "g1", "g2", "x"]

    @pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("beta1", "beta2", "beta", "se", "t")]))
    def run(m: pd.DataFrame) -> pd.DataFrame:
        column = {k: m[k].to_numpy(float) for k in m}
        n, size = column["n"], len(terms)
        xtx = np.array([[column[cross(a, b)] for b in terms] for a in terms]).transpose(2, 0, 1)
        xty = np.array([column[cross(a, "y")] for a in terms]).T
        scale = np.sqrt(np.maximum(np.einsum("pii->pi", xtx), 1e-300)) if covariates else np.ones((len(n), size))
        scaled = xtx / scale[:, :, None] / scale[:, None, :]  # covariates may have any unit
        good = (n >= 20) & (np.linalg.cond(scaled) < 1e10)
        inv = np.zeros_like(xtx)
        inv[good] = np.linalg.inv(scaled[good]) / scale[good][:, :, None] / scale[good][:, None, :]
        b = (inv @ xty[:, :, None])[:, :, 0]
        rss = np.maximum(column["yy"] - (b * xty).sum(1), 0.0)
        se = np.sqrt(np.maximum(rss / np.maximum(n - size, 1) * inv[:, -1, -1], 0.0))
        t = np.divide(b[:, -1], se, out=np.zeros_like(se), where=good & (se > 0))
        return pd.DataFrame({"beta1": b[:, -3], "beta2": b[:, -2], "beta": b[:, -1], "se": se, "t": t})

    return run


def test_interactions(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, covariates: tuple[str, ...] = ()) -> DataFrame:
    """(v1, v2, beta1, beta2, beta, se, p_value) for each pair with a shared carrier, adjusted for the covariates."""
    m = interaction_moments(genotypes, samples, pairs, covariates)
    columns = [c for c in m.columns if c not in ("v1", "v2")]
    fit = m.select("v1", "v2", "n", _interaction_fit(len(covariates))(F.struct(*columns)).alias("f")).select("v1", "v2", "n", "f.*")
    return fit.select("v1", "v2", "beta1", "beta2", "beta", "se", t_p("t", F.col("n") - 4 - len(covariates)).alias("p_value"))


test_interactions.__test__ = False


def benjamini_hochberg(df: DataFrame, p: str = "p_value", name: str = "p_corrected", parts: int = 64) -> DataFrame:
    """Adjusted p over all rows, monotone; a null p stays null. Runs df.

    Works on distinct values, so that a value which many rows share is one row, and in ranges of them cut at quantiles: the
    driver holds three numbers for each range, no window more than a range."""
    df = written(df)
    by = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    cuts = by.agg(F.percentile_approx("_p", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    edges = F.lit(sorted({float(c) for c in cuts}) or [0.0]).cast("array<double>")
    rows = cut(by.withColumn("_part", F.size(F.filter(edges, lambda e: e < F.col("_p")))))
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}
    total, before, run = sum(sizes.values()), {}, 0
    for k in sorted(sizes):
        before[k], run = run, run + sizes[k]
    number = lambda found, k: F.element_at(F.create_map(*[F.lit(x) for e in found.items() for x in e]), k) if found else F.lit(0)
    inside = Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_q", F.least(F.col("_p") * float(total) / (number(before, F.col("_part")) + F.sum("_n").over(inside)), F.lit(1.0)))
    lows, least = {}, 1.0
    for r in sorted(ranked.groupBy("_part").agg(F.min("_q").alias("q")).collect(), key=lambda r: -r["_part"]):
        lows[r["_part"]], least = least, min(least, r["q"])
    after = F.min("_q").over(Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    found = ranked.select("_p", F.least(after, number(lows, F.col("_part")).cast("double")).alias(name))
    return df.join(found, F.col(p) == F.col("_p"), "left").drop("_p")


def bonferroni(df: DataFrame, p: str = "p_value", name: str = "p_corrected") -> DataFrame:
    """p times the number of rows, at most 1; the rows are counted first."""
    df = written(df)
    return df.withColumn(name, F.least(F.col(p) * float(df.count()), F.lit(1.0)))


def motif_pairs(motif: str, variant_gene: DataFrame, gene_pathway: DataFrame | None = None, ppi: DataFrame | None = None, variants: DataFrame | None = None, min_gap: int = 1000, direct: bool = False) -> DataFrame:
    """(v1, v2, motif, entity), v1 < v2, each pair once: same_gene (more than min_gap apart), same_pathway (of different
    genes), protein_interaction (variants whose genes share a partner; direct: whose genes interact)."""
    vg = variant_gene.select("v", "gene").distinct()
    a, b = vg.select(F.col("v").alias("v1"), F.col("gene").alias("ga")), vg.select(F.col("v").alias("v2"), F.col("gene").alias("gb"))
    # Where no variant has two genes, each two variants have one pair of genes.
    gene_of_one = motif == "same_pathway" and vg.groupBy("v").count().where("count > 1").isEmpty()
    if motif == "same_gene":
        out = a.join(b, F.col("ga") == F.col("gb")).where("v1 < v2").select("v1", "v2", F.col("ga").cast("string").alias("entity"))
        if variants is not None:
            for k in ("1", "2"):
                out = out.join(variants.select(F.col("v").alias(f"v{k}"), F.col("pos").alias(f"p{k}")), f"v{k}")
            out = out.where(F.abs(F.col("p1") - F.col("p2")) > min_gap)
    elif motif == "same_pathway":
        # A pair is made under the least pathway that its genes share, so nothing is left to merge; a pathway's pairs are dealt
        # to parts, since pathways may be few and large.
        gp = gene_pathway.select("gene", "pathway").distinct()
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        if gene_of_one:
            # Genes meet, with lists of their variants and of the pathways before; pairs of variants are made last.
            own = gp.groupBy("gene").agg(F.collect_set("pathway").alias("all"))
            held = vg.groupBy("gene").agg(F.collect_list("v").alias("vs"))
            held = held.join(gp.join(own, "gene").select("gene", "pathway", F.filter("all", lambda p: p < F.col("pathway")).alias("before")), "gene")
            one, two = (held.select("pathway", *[F.col(c).alias(f"{c}{k}") for c in ("gene", "vs", "before")]) for k in ("1", "2"))
            one = one.withColumn("part", F.pmod(F.xxhash64("gene1"), F.lit(PARTS)).cast("int"))
            # Genes are few bytes and their pairs are many: a fixed number of partitions, which adaptive execution does not merge.
            spread = max(64, int(vg.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            met = one.repartition(spread, "pathway", "part").join(two.withColumn("part", parts).repartition(spread, "pathway", "part"), ["pathway", "part"]).where((F.col("gene1") < F.col("gene2")) & ~F.arrays_overlap("before1", "before2"))
            each = met.select("pathway", "vs2", F.explode("vs1").alias("x")).select("pathway", "x", F.explode("vs2").alias("y"))
            return each.select(F.least("x", "y").alias("v1"), F.greatest("x", "y").alias("v2"), F.col("pathway").alias("entity"), F.lit(motif).alias("motif"))
        part = F.pmod(F.xxhash64("v1"), F.lit(PARTS)).cast("int").alias("part")
        pa = a.join(gp.select(F.col("gene").alias("ga"), "pathway"), "ga").withColumn("part", part)
        pb = b.join(gp.select(F.col("gene").alias("gb"), "pathway"), "gb").withColumn("part", parts)
        met = pa.join(pb, ["pathway", "part"]).where("v1 < v2 AND ga <> gb")
        out = met.select("v1", "v2", F.col("pathway").alias("entity"))
    elif motif == "protein_interaction":
        both = ppi.select("a", "b").union(ppi.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        if direct:
            out = a.join(both, F.col("ga") == F.col("a")).join(b, F.col("b") == F.col("gb")).where("v1 < v2").select("v1", "v2", F.concat_ws("-", "ga", "gb").alias("entity"))
        else:
            pa = a.join(both.select(F.col("a").alias("ga"), F.col("b").alias("partner")), "ga")
            pb = b.join(both.select(F.col("a").alias("gb"), F.col("b").alias("partner")), "gb")
            out = pa.join(pb, "partner").where("v1 < v2 AND ga <> gb").select("v1", "v2", F.col("partner").cast("string").alias("entity"))
    else:
        raise ValueError(motif)
    return out.groupBy("v1", "v2").agg(F.min("entity").alias("entity")).withColumn("motif", F.lit(motif))


def motif_scan(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, mac_min: int = 10, correction: str = "BH", covariates: tuple[str, ...] = ()) -> DataFrame:
    """Interactions of motif pairs whose variants have mac_min minor alleles, corrected over all pairs; of several motifs
    the first by name is kept."""
    one = pairs.groupBy("v1", "v2").agg(F.min_by("entity", "motif").alias("entity"), F.min("motif").alias("motif"))
    n = samples.count()
    mac = genotypes.groupBy("v").agg(F.sum("g").alias("k")).where(F.least(F.col("k"), F.lit(2 * n) - F.col("k")) >= mac_min).select("v")
    for k in ("v1", "v2"):
        one = one.join(mac.select(F.col("v").alias(k)), k, "left_semi")
    tested = test_interactions(genotypes, samples, one, covariates)
    out = benjamini_hochberg(tested) if correction == "BH" else bonferroni(tested)
    return out.join(one, ["v1", "v2"])


def ld_prune(genotypes: DataFrame, variants: DataFrame, n_samples: int, r2_prune: float = 0.5, distance: int = 100_000) -> DataFrame:
    """variants that stay: by position, one goes if it is linked above r2_prune within distance to one that stayed."""
    near = ld_pairs(genotypes, variants, n_samples, distance).where(F.col("r2") > r2_prune)
    links = near.select(F.col("v1").alias("v"), F.col("v2").alias("u")).union(near.select(F.col("v2").alias("v"), F.col("v1").alias("u"))).groupBy("v").agg(F.collect_set("u").alias("linked"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set = set()
        for r in pdf.sort_values(["pos", "v"]).itertuples():
            if r.linked is None or not kept.intersection(r.linked):
                kept.add(r.v)
        return pdf[pdf["v"].isin(kept)].drop(columns=["linked", "_piece"])

    # Chromosomes are cut at gaps wider than distance, which no link crosses; each piece is one group.
    order = Window.partitionBy("chr").orderBy("pos", "v")
    far = (F.col("pos") - F.lag("pos").over(order) > distance).cast("int")
    pieces = variants.withColumn("_far", far).withColumn("_piece", F.sum(F.coalesce("_far", F.lit(0))).over(order)).drop("_far")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in variants.schema)
    return pieces.join(links, "v", "left").groupBy("chr", "_piece").applyInPandas(run, schema)


def pruned_cooccurrence(genotypes: DataFrame, samples: DataFrame, variants: DataFrame, r2_prune: float = 0.5, min_cocarriers: int = 5, min_distance: int = 100_000, reach: int = 10_000_000, p_max: float = 0.05) -> DataFrame:
    """Interactions (p < p_max, Bonferroni over tested pairs) of pruned variants at least min_distance apart that share
    min_cocarriers case carriers; without case labels the upper and lower quarter of y are cases and controls."""
    if samples.where("is_case IS NOT NULL").isEmpty():
        q = samples.agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
        samples = samples.withColumn("is_case", F.when(F.col("y") >= q[1], True).when(F.col("y") <= q[0], False))
    kept = ld_prune(genotypes, variants, samples.count(), r2_prune, min_distance)
    pairs = carrier_pairs(genotypes, samples, window_pairs(kept, reach, min_distance)).where(F.col("co_case") >= min_cocarriers)
    return bonferroni(test_interactions(genotypes, samples, pairs)).where(F.col("p_value") < p_max)


def differential(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, min_cocarriers: int = 5) -> DataFrame:
    """(v1, v2, co_case, co_ctrl, lfr, edge_type, fisher, p_corrected) of pairs carried together twice in either group;
    corrected by their total number."""
    n_case, n_ctrl = _sizes(samples)
    c = carrier_pairs(genotypes, samples, pairs).where("co_case >= 2 OR co_ctrl >= 2")
    pseudo = 1.0 / max(n_case, n_ctrl)
    out = c.withColumn("lfr", F.log2((F.col("co_case") / n_case + pseudo) / (F.col("co_ctrl") / n_ctrl + pseudo)))
    kind = F.when((F.col("co_case") >= min_cocarriers) & (F.col("co_ctrl") < 2), "case_unique").when((F.col("co_ctrl") >= min_cocarriers) & (F.col("co_case") < 2), "ctrl_unique").when(F.abs("lfr") > 1, "differential").otherwise("shared")
    out = out.withColumn("edge_type", kind).withColumn("fisher", fisher_p("co_case", F.lit(n_case) - F.col("co_case"), "co_ctrl", F.lit(n_ctrl) - F.col("co_ctrl")))
    out = bonferroni(out, "fisher")
    return out.where("fisher < 0.05 OR edge_type IN ('case_unique', 'ctrl_unique')")


def depletion(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, threshold: float = 0.5, min_expected: float = 5.0) -> DataFrame:
    """(v1, v2, observed and expected counts, ratios, poisson, z_difference, p_corrected): pairs that cases carry together
    less often than independence has it. All given pairs count, also those that nobody carries."""
    n_case, n_ctrl = _sizes(samples)
    f = genotypes.where("g > 0").join(samples.where("is_case IS NOT NULL").select("s", "is_case"), "s").groupBy("v").agg((F.count_if("is_case") / n_case).alias("a"), (F.count_if(~F.col("is_case")) / n_ctrl).alias("b"))
    rows = pairs.select("v1", "v2")
    for k in ("1", "2"):
        rows = rows.join(f.select(F.col("v").alias(f"v{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")), f"v{k}")
    rows = rows.select("v1", "v2", (n_case * F.col("a1") * F.col("a2")).alias("exp_case"), (n_ctrl * F.col("b1") * F.col("b2")).alias("exp_ctrl")).where(F.col("exp_case") >= min_expected)
    out = rows.join(carrier_pairs(genotypes, samples, rows), ["v1", "v2"], "left").fillna(0, ["co_case", "co_ctrl"])
    ratio = lambda g: F.when(F.col(f"exp_{g}") > 0, F.col(f"co_{g}") / F.col(f"exp_{g}")).otherwise(1.0)
    out = out.withColumns({"ratio_case": ratio("case"), "ratio_ctrl": ratio("ctrl"), "poisson": poisson_p("co_case", "exp_case")})
    z1 = (F.col("co_case") - F.col("exp_case")) / F.sqrt(F.col("exp_case") + 1)
    z2 = (F.col("co_ctrl") - F.col("exp_ctrl")) / F.sqrt(F.greatest("exp_ctrl", F.lit(1.0)) + 1)
    out = bonferroni(out.withColumn("z_difference", z2 - z1), "poisson")
    return out.where(((F.col("ratio_case") < threshold) & (F.col("ratio_ctrl") > threshold)) | ((F.col("poisson") < 0.01) & (F.col("z_difference") > 1)))


def mdr(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, folds: int = 10) -> DataFrame:
    """(v1, v2, accuracy): multifactor dimensionality reduction; nine cells, high risk where the training folds' case rate
    is at least the overall one; balanced accuracy on the fold left out, mean over folds. Folds by md5 of the sample; a
    fold without cases or controls does not count."""
    known = samples.where("is_case IS NOT NULL").select("s", "is_case", (md5_number(F.col("s")) % folds).cast("int").alias("fold"))
    size = known.groupBy("fold").agg(F.count_if("is_case").alias("na"), F.count_if(~F.col("is_case")).alias("nb"))
    g = genotypes.where("g > 0").select("v", "s", "g")
    left = pairs.select("v1", "v2").join(g.select(F.col("v").alias("v1"), "s", F.col("g").alias("g1")), "v1")
    right = pairs.select("v1", "v2").join(g.select(F.col("v").alias("v2"), "s", F.col("g").alias("g2")), "v2")
    cells = left.join(right, ["v1", "v2", "s"], "full").fillna(0, ["g1", "g2"]).join(known, "s")
    seen = cells.groupBy("v1", "v2", "fold", "g1", "g2").agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b"))
    # The double non-carriers of each fold follow from its size.
    shown = seen.groupBy("v1", "v2", "fold").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    grid = pairs.select("v1", "v2").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(size, "fold")
    zero = grid.join(shown, ["v1", "v2", "fold"], "left").select("v1", "v2", "fold", F.lit(0).alias("g1"), F.lit(0).alias("g2"), (F.col("na") - F.coalesce("sa", F.lit(0))).alias("a"), (F.col("nb") - F.coalesce("sb", F.lit(0))).alias("b"))
    all_ = seen.unionByName(zero)
    cell, pair = Window.partitionBy("v1", "v2", "g1", "g2"), Window.partitionBy("v1", "v2")
    fold = Window.partitionBy("v1", "v2", "fold")
    rest = lambda c, w, f: F.sum(c).over(w) - (F.sum(c).over(f) if f is not None else F.col(c))
    rows = all_.withColumns({"ta": rest("a", cell, None), "tb": rest("b", cell, None), "pa": rest("a", pair, fold), "pb": rest("b", pair, fold)})
    high = F.col("ta") * F.col("pb") >= F.col("tb") * F.col("pa")
    high = high & (F.col("ta") + F.col("tb") > 0)
    per = rows.groupBy("v1", "v2", "fold").agg(F.try_divide(F.sum(F.when(high, F.col("a")).otherwise(0)), F.sum("a")).alias("sens"), F.try_divide(F.sum(F.when(high, F.lit(0)).otherwise(F.col("b"))), F.sum("b")).alias("spec"))
    return per.groupBy("v1", "v2").agg(F.avg((F.col("sens") + F.col("spec")) / 2).alias("accuracy"))


def pair_chi2(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v1, v2, chi2): 2x2 carrier-by-carrier odds compared between cases and controls (log odds difference squared over
    its variance, halves added)."""
    n_case, n_ctrl = _sizes(samples)
    one = genotypes.where("g > 0").join(samples.where("is_case IS NOT NULL").select("s", "is_case"), "s").groupBy("v").agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b"))
    rows = pairs.select("v1", "v2").join(carrier_pairs(genotypes, samples, pairs), ["v1", "v2"], "left").fillna(0, ["co_case", "co_ctrl"])
    for k in ("1", "2"):
        rows = rows.join(one.select(F.col("v").alias(f"v{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")), f"v{k}")
    h = 0.5

    def odds(co, x, y, n):
        cells = [F.col(co) + h, F.col(x) - F.col(co) + h, F.col(y) - F.col(co) + h, F.lit(n) - F.col(x) - F.col(y) + F.col(co) + h]
        return F.log(cells[0] * cells[3] / (cells[1] * cells[2])), sum((1 / c for c in cells), F.lit(0.0))

    la, va = odds("co_case", "a1", "a2", n_case)
    lb, vb = odds("co_ctrl", "b1", "b2", n_ctrl)
    return rows.select("v1", "v2", (F.pow(la - lb, 2) / (va + vb)).alias("chi2"))


def interaction_matrix(genotypes: DataFrame, samples: DataFrame, pairs: DataFrame, block: int | None = None, digits: int | None = None) -> DataFrame:
    """(v1, v2, s, x): products of mean-centred dosages for every sample, rounded to digits where they are given; about block samples
    meet a pair at once, by default a 64th of all, 256 to 1,024."""
    n = samples.count()
    g = genotypes.select("v", "s", "g")
    mean = g.groupBy("v").agg((F.sum("g") / n).alias("m"))
    rows = pairs.select("v1", "v2")
    for k in ("1", "2"):
        rows = rows.join(mean.select(F.col("v").alias(f"v{k}"), F.col("m").alias(f"m{k}")), f"v{k}")
    value = lambda x: x if digits is None else rounded_to(x, digits)
    # Every pair has a row for each sample by definition. Pairs meet blocks of samples; a block's carriers travel as one map, and
    # rows of samples are made last, so that none is shuffled. What a sample without either variant has is worked out once a pair.
    n_blocks = max(1, -(-n // (block or min(1024, max(256, n // 64)))))
    of = F.pmod(F.xxhash64("s"), F.lit(n_blocks)).cast("int").alias("block")
    carriers = g.where("g IS NOT NULL AND s IS NOT NULL").groupBy("v", of).agg(F.map_from_entries(F.collect_list(F.struct("s", "g"))).alias("held"))
    people = samples.groupBy(of).agg(F.collect_list(F.struct("s")).alias("ids"))
    rows = rows.withColumn("none", value(F.col("m1") * F.col("m2"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    for k in ("1", "2"):
        rows = rows.join(carriers.select(F.col("v").alias(f"v{k}"), "block", F.col("held").alias(f"held{k}")), [f"v{k}", "block"], "left")
    dense = rows.join(people, "block").select("v1", "v2", "m1", "m2", "none", "held1", "held2", F.inline("ids"))
    dense = dense.select("v1", "v2", "s", "m1", "m2", "none", *[F.try_element_at(f"held{k}", F.col("s")).alias(f"g{k}") for k in ("1", "2")])
    dose = lambda k: F.coalesce(f"g{k}", F.lit(0)) - F.col(f"m{k}")
    return dense.select("v1", "v2", "s", F.when(F.col("g1").isNull() & F.col("g2").isNull(), F.col("none")).otherwise(value(dose(1) * dose(2))).alias("x"))
