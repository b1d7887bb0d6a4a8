"""Flow from cases through variants and genes to pathways."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut, written
from strandline.operators.graph import max_flow

#: Capacity of a variant-gene edge by impact.
IMPACT = {"HIGH": 1.0, "MODERATE": 0.5, "LOW": 0.1, "MODIFIER": 0.01}


def network(genotypes: DataFrame, sources: DataFrame, variant_gene: DataFrame, gene_pathway: DataFrame, n_samples: int, af_threshold: float = 0.05, scaled_pathways: bool = False) -> DataFrame:
    """(src, dst, cap, kind): SOURCE -> sample 1, sample -> variant 1/af, variant -> gene by impact (the largest), gene ->
    pathway 1 (or 1 over the root of its genes). sources: (s); variant_gene: (v, gene, impact).

    Carriers are found at once and written; genotypes are read twice."""
    use = variant_gene.where(F.col("impact").isin("HIGH", "MODERATE"))
    af = genotypes.groupBy("v").agg(F.greatest(F.sum("g") / (2.0 * n_samples), F.lit(1e-6)).alias("af")).where(F.col("af") < af_threshold)
    hit = genotypes.where("g > 0").join(sources.select("s"), "s").join(af, "v").join(use.select("v").distinct(), "v", "left_semi")
    hit = written(hit.select("v", "s", "af"))  # all kinds of edges follow from it
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv]), F.col("impact"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda a, b, c, k: [a.alias("src"), b.alias("dst"), c.cast("double").alias("cap"), F.lit(k).alias("kind")]
    seen = hit.select("v").distinct()
    vg = use.join(seen, "v").groupBy("v", "gene").agg(F.max(cap).alias("cap"))
    gp = gene_pathway.select("gene", "pathway").distinct()
    if scaled_pathways:
        gp = gp.join(gp.groupBy("pathway").agg((1 / F.sqrt(F.count("*"))).alias("cap")), "pathway")
    else:
        gp = gp.withColumn("cap", F.lit(1.0))
    out = hit.select("s").distinct().select(*edge(F.lit("SOURCE"), name("S:", "s"), F.lit(1.0), "source"))
    out = out.union(hit.select(*edge(name("S:", "s"), name("V:", "v"), 1 / F.col("af"), "carries")))
    out = out.union(vg.select(*edge(name("V:", "v"), name("G:", "gene"), F.col("cap"), "in_gene")))
    return out.union(gp.join(vg.select("gene").distinct(), "gene").select(*edge(name("G:", "gene"), name("P:", "pathway"), F.col("cap"), "in_pathway")))


def _parts(edges: DataFrame, by: list[str]) -> tuple[DataFrame, ...]:
    """Pathways' own networks: in_pathway, in_gene, carries and source edges with their pathway; carries also with the number of
    edges that its sample has in the pathway (m) and the capacity of its source edge (full).

    An edge of a carrier is dealt once, by sample, with the list of its variant's pathways; copies for pathways are made there."""
    kinds = {k: edges.where(F.col("kind") == k).drop("kind") for k in ("source", "carries", "in_gene", "in_pathway")}
    p = kinds["in_pathway"].withColumn("pathway", F.col("dst"))
    g = kinds["in_gene"].join(p.select(*by, F.col("src").alias("dst"), "pathway"), [*by, "dst"]).select(*by, "src", "dst", "cap", "pathway")
    of = g.groupBy(*by, F.col("src").alias("dst")).agg(F.collect_set("pathway").alias("pathways"))
    full = kinds["source"].groupBy(*by, F.col("dst").alias("src")).agg(F.sum("cap").alias("full"))
    dealt = kinds["carries"].join(of, [*by, "dst"]).repartition(*by, "src")
    v = dealt.join(full, [*by, "src"]).select(*by, "src", "dst", "cap", "full", F.explode("pathways").alias("pathway"))
    return p, g, v.withColumn("m", F.count("*").over(Window.partitionBy(*by, "src", "pathway"))), kinds["source"]


def _split(g: DataFrame, v: DataFrame, by: list[str], rounds: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rich, poor, left): variants (*by, pathway, dst) that their carriers surely fill, the others, and the carriers' edges that
    matter to these.

    A sample that carries no poor variant of a pathway gives each of its m variants there an m-th of its capacity. Whoever gets
    more than all it can pass on is rich: all such samples keep a rest, so every maximum flow fills it, it is never on the
    sink's side of a cut, and its carriers bind nothing. Poor ones take their samples away from others until nothing changes."""
    key = [*by, "pathway", "dst"]
    need = g.groupBy(*by, "pathway", F.col("src").alias("dst")).agg(F.sum("cap").alias("need"))
    share = F.least(F.col("cap"), F.col("full") / F.col("m"))
    got = written(v.groupBy(*key).agg(F.sum(share).alias("got")).join(need, key).withColumn("rich", F.col("got") > F.col("need") * (1 + 1e-9)))
    for _ in range(rounds):
        poor = got.where("NOT rich").select(*key)
        if poor.isEmpty():
            return got.select(*key), poor, v.limit(0)
        taken = v.join(poor, key, "left_semi").select(*by, "pathway", "src").distinct()
        left = written(v.join(taken, [*by, "pathway", "src"], "left_semi"))
        lost = left.groupBy(*key).agg(F.sum(share).alias("lost"))
        more = got.join(lost, key, "left").withColumn("rich", F.col("rich") & (F.col("got") - F.coalesce("lost", F.lit(0.0)) > F.col("need") * (1 + 1e-9)))
        more = written(more.drop("lost"))
        if more.where("rich").count() == got.where("rich").count():
            return more.where("rich").select(*key), more.where("NOT rich").select(*key), left.join(more.where("NOT rich").select(*key), key, "left_semi")
        got = more
    return got.select(*key).limit(0), got.select(*key), v


def pathway_flows(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, pathway, flow, cut): maximum flow into each pathway and the nodes on its minimum cut, the one nearest the source.

    Carriers of variants that are surely filled are left out (_split); what is left of a pathway's network (its genes, their
    variants, carriers of scarce ones) is one group: few rows where carriers outnumber what genes can take."""
    by = list(by)
    p, g, v, source = _parts(edges, by)
    g, v = written(g), written(v)
    rich, _, left = _split(g, v, by)
    # A filled variant stands at the source, with more than it can pass on.
    out = g.groupBy(*by, "pathway", F.col("src").alias("dst")).agg((2 * F.sum("cap") + 1).alias("cap"))
    filled = rich.join(out, [*by, "pathway", "dst"]).select(*by, F.lit("SOURCE").alias("src"), "dst", "cap", "pathway")
    c = left.select(*by, "src", "dst", "cap", "pathway")
    s = source.join(c.select(*by, F.col("src").alias("dst"), "pathway").distinct(), [*by, "dst"]).select(*by, "src", "dst", "cap", "pathway")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, cut = max_flow(list(pdf[["src", "dst", "cap"]].itertuples(index=False, name=None)), "SOURCE", pdf["pathway"].iloc[0])
        nodes = sorted({x for e in cut for x in e if x != "SOURCE"})
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "pathway": [pdf["pathway"].iloc[0][2:]], "flow": [value], "cut": [nodes]})

    extra = "".join(f"{b} {edges.schema[b].dataType.simpleString()}, " for b in by)
    rows = p.select(*by, "src", "dst", "cap", "pathway").union(g).union(filled).union(c).union(s)
    return rows.groupBy(*by, "pathway").applyInPandas(run, f"{extra}pathway string, flow double, cut array<string>")


def _shares(rows: DataFrame, draws: int) -> DataFrame:
    """(pathway, v, got, carried): for each draw what a variant gets of its carriers and how many it has there; rows: (pathway, v,
    share, held), held the draws in which the carrier is a case, eight to a byte."""

    def run(batches):
        for b in batches:
            names, shares = np.array(b["_k"].to_numpy(zero_copy_only=False)), b["share"].to_numpy(zero_copy_only=False)
            for k in range(0, b.num_rows, 2000):
                key, w = names[k : k + 2000], shares[k : k + 2000]
                bits = np.unpackbits(np.frombuffer(b"".join(b["held"][k : k + 2000].to_pylist()), np.uint8).reshape(len(key), -1), axis=1, bitorder="little")[:, :draws]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                got, carried = np.add.reduceat(bits * w[:, None], at), np.add.reduceat(bits.astype(np.int64), at)
                pa_list = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, draws), pa.int32()), pa.array(x.ravel(), t))
                yield pa.RecordBatch.from_arrays([b["pathway"].slice(k, 2000).take(pa.array(at)), b["v"].slice(k, 2000).take(pa.array(at)), pa_list(got, pa.float64()), pa_list(carried, pa.int64())], ["pathway", "v", "got", "carried"])

    keyed = rows.withColumn("_k", F.xxhash64("pathway", "v")).repartition("pathway", "v").sortWithinPartitions("_k", "pathway", "v")
    parts = keyed.mapInArrow(run, "pathway string, v string, got array<double>, carried array<long>")
    # A variant's rows may lie in several pieces.
    flat = parts.select("pathway", "v", F.posexplode(F.arrays_zip("got", "carried")).alias("d", "x"))
    return flat.groupBy("pathway", "v", (F.col("d") + 1).alias("d")).agg(F.sum("x.got").alias("got"), F.sum("x.carried").alias("carried"))


def observed_and_null(genotypes: DataFrame, samples: DataFrame, variant_gene: DataFrame, gene_pathway: DataFrame, af_threshold: float = 0.05, draws: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Flows of the cases' network, and (d, pathway, flow) of networks of permuted case labels, carriers built anew for each.

    Labels come from a hash of sample and draw, so partitions do not matter. All draws' shares (see _split) are sums over one
    table of carriers; a draw whose carried variants of a pathway are all surely filled has the flow that its genes can take, and
    only networks of other draws are made."""
    n, n_case = samples.count(), samples.where("is_case").count()
    genotypes = written(genotypes.select("v", "s", "g"))
    seen = pathway_flows(network(genotypes, samples.where("is_case"), variant_gene, gene_pathway, n, af_threshold))
    order = F.xxhash64("s", "d", F.lit(seed))
    label = samples.where("is_case IS NOT NULL").select("s").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    cases = written(label.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(order, "s"))).where(F.col("k") <= n_case).select("s", "d"))
    every = written(network(genotypes, samples, variant_gene, gene_pathway, n, af_threshold))
    who = cases.select(F.concat(F.lit("S:"), F.col("s").cast("string")).alias("n"), "d")
    p, g, v, source = _parts(every, [])
    g = written(g)
    bytes_ = [F.coalesce(F.sum(F.when((F.col("d") - 1).between(8 * k, 8 * k + 7), F.expr("shiftleft(1, CAST((d - 1) % 8 AS INT))"))), F.lit(0)) for k in range((draws + 7) // 8)]
    held = who.groupBy("n").agg(F.unhex(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in bytes_])).alias("held"))
    share = F.least(F.col("cap"), F.col("full") / F.col("m"))
    got = _shares(v.join(held, v.src == held.n).select("pathway", F.col("dst").alias("v"), share.alias("share"), "held"), draws).where("carried > 0")
    need = g.groupBy("pathway", F.col("src").alias("v")).agg(F.sum("cap").alias("need"))
    state = written(got.join(need, ["pathway", "v"]).select("d", "pathway", "v", (F.col("got") > F.col("need") * (1 + 1e-9)).alias("rich")))
    open_ = state.where("NOT rich").select("d", "pathway").distinct()
    # What filled variants can pass on to each gene, and that gene to the pathway.
    into = p.groupBy(F.col("src").alias("dst"), "pathway").agg(F.sum("cap").alias("room"))
    flows = state.join(open_, ["d", "pathway"], "left_anti").join(g.withColumnRenamed("src", "v"), ["pathway", "v"]).groupBy("d", "pathway", "dst").agg(F.sum("cap").alias("cap")).join(into, ["dst", "pathway"])
    full = flows.groupBy("d", "pathway").agg(F.sum(F.least("cap", "room")).alias("flow")).select("d", F.substring("pathway", 3, 1 << 30).alias("pathway"), "flow")
    some = v.join(open_, "pathway").join(who.withColumnRenamed("n", "src"), ["src", "d"])
    nets = p.join(open_, "pathway").select("d", "src", "dst", "cap", F.lit("in_pathway").alias("kind"))
    nets = nets.union(g.join(open_, "pathway").select("d", "src", "dst", "cap", F.lit("in_gene").alias("kind")).distinct())
    nets = nets.union(some.select("d", "src", "dst", "cap", F.lit("carries").alias("kind")).distinct())
    nets = nets.union(some.select("d", F.lit("SOURCE").alias("src"), F.col("src").alias("dst"), F.col("full").alias("cap"), F.lit("source").alias("kind")).distinct())
    hard = full.limit(0) if open_.isEmpty() else pathway_flows(written(nets), ("d",)).select("d", "pathway", "flow").join(open_.select("d", F.substring("pathway", 3, 1 << 30).alias("pathway")), ["d", "pathway"], "left_semi")
    none = p.select(F.substring("pathway", 3, 1 << 30).alias("pathway")).distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    known = written(full.union(hard.select("d", "pathway", "flow")))
    return seen, known.union(none.join(known, ["d", "pathway"], "left_anti").select("d", "pathway", F.lit(0.0).alias("flow")))


def test_flows(genotypes: DataFrame, samples: DataFrame, variant_gene: DataFrame, gene_pathway: DataFrame, af_threshold: float = 0.05, draws: int = 100, seed: int = 42) -> DataFrame:
    """(pathway, flow, p_value, cut): observed flows against the permuted ones, p = (hits + 1) / (draws + 1)."""
    seen, null = observed_and_null(genotypes, samples, variant_gene, gene_pathway, af_threshold, draws, seed)
    hits = seen.join(null.select("pathway", F.col("flow").alias("f")), "pathway", "left").groupBy("pathway").agg(F.count_if(F.col("f") >= F.col("flow") - 1e-9).alias("k"))
    return seen.join(hits, "pathway").select("pathway", "flow", ((F.col("k") + 1) / (draws + 1)).alias("p_value"), "cut")


test_flows.__test__ = False


def heritability(genotypes: DataFrame, samples: DataFrame, variant_gene: DataFrame, gene_pathway: DataFrame, af_threshold: float = 0.05, draws: int = 100, seed: int = 42) -> DataFrame:
    """(pathway, flow, fraction, h2_contribution, h2_total, p_value): excess of the total flow over the mean of the permuted
    totals, relative to it and at least 0, split by the pathways' flows; p of the total."""
    seen, null = observed_and_null(genotypes, samples, variant_gene, gene_pathway, af_threshold, draws, seed)
    seen = cut(seen)
    total = float(seen.agg(F.sum("flow")).first()[0] or 0.0)
    sums = null.groupBy("d").agg(F.sum("flow").alias("t"))
    row = sums.agg(F.sum("t").alias("s"), F.count_if(F.col("t") >= total - 1e-9).alias("k")).first()
    mean = float(row["s"] or 0.0) / draws
    h2 = max(0.0, (total - mean) / total) if mean > 0 and total > 0 else float(total > 0)
    fraction = F.col("flow") / (total or 1.0)
    return seen.select("pathway", "flow", fraction.alias("fraction"), (fraction * h2).alias("h2_contribution"), F.lit(h2).alias("h2_total"), F.lit((row["k"] + 1) / (draws + 1)).alias("p_value"))


def architecture(tested: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """One row: significant pathways and the union of their cuts."""
    ok = tested.where(F.col("p_value") < p_threshold)
    return ok.agg(F.array_sort(F.collect_set("pathway")).alias("pathways"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("nodes"))
