import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import special as S
from strandline.operators import assoc, bias, epistasis, finemap, flow, gene_tests, genotype, graph, intervals, met, mr, multivariate, prs, qc, rwr, simulate, store, structure, sumstats, sv


def test_special_functions_against_closed_forms(spark):
    assert S.betainc(1, 1, 0.3) == pytest.approx(0.3) and S.betainc(2, 2, 0.5) == pytest.approx(0.5)
    assert S.t_two_sided(1.0, 1) == pytest.approx(0.5) and S.t_two_sided(12.706204736, 1) == pytest.approx(0.05, rel=1e-6)
    assert S.chi2_sf(3.841458821, 1) == pytest.approx(0.05, rel=1e-6) and S.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1))
    assert S.poisson_cdf(2, 1.5) == pytest.approx(math.exp(-1.5) * (1 + 1.5 + 1.125))
    assert S.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70) and S.fisher_two_sided(0, 5, 5, 0) == pytest.approx(2 / 252)
    assert S.hwe_exact(0, 0, 10) == 1.0 and S.hwe_exact(50, 25, 100) == pytest.approx(1.0) and S.hwe_exact(0, 50, 100) < 1e-20
    assert S.betainc_inv(3, 5, S.betainc(3, 5, 0.4)) == pytest.approx(0.4)
    x = [-3.0, -0.5, 0.0, 0.7, 2.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(S.erfc_col(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=2e-7)


@pytest.fixture(scope="module")
def panel(spark):
    """Dense draws as sparse tables: y depends on variant 3; cases on variant 5; 6 copies 5 in part."""
    rng = np.random.default_rng(11)
    g = rng.binomial(2, rng.uniform(0.1, 0.5, 12)[:, None], (12, 400))
    g[6] = np.where(rng.random(400) < 0.9, g[5], g[6])
    y = 0.8 * g[3] + rng.standard_normal(400)
    case = rng.random(400) < 1 / (1 + np.exp(-(g[5] * 1.0 - 1)))
    gt = spark.createDataFrame([(int(v), int(s), int(g[v, s])) for v in range(12) for s in range(400) if g[v, s]], "v long, s long, g int").cache()
    samples = spark.createDataFrame([(s, float(y[s]), bool(case[s])) for s in range(400)], "s long, y double, is_case boolean").cache()
    variants = spark.createDataFrame([(v, 1, 1000 * v + 1) for v in range(12)], "v long, chr int, pos long")
    return g, y, case, gt, samples, variants


def rows(df, key="v"):
    return {r[key]: r for r in df.collect()}


def test_scans_against_numpy(panel):
    g, y, case, gt, s, _ = panel
    lin = rows(assoc.linear_scan(gt, s))
    for v in range(12):
        x = np.column_stack([np.ones(400), g[v]])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        r = y - x @ b
        se = math.sqrt(r @ r / 398 * np.linalg.inv(x.T @ x)[1, 1])
        assert lin[v]["beta"] == pytest.approx(b[1]) and lin[v]["t"] == pytest.approx(b[1] / se)
        assert lin[v]["p_value"] == pytest.approx(S.t_two_sided(b[1] / se, 398), rel=1e-6)
    assert min(lin, key=lambda v: lin[v]["p_value"]) == 3
    auto = rows(assoc.single_locus_scan(gt, s))
    assert min(auto, key=lambda v: auto[v]["p_value"]) in (5, 6) and set(r["method"] for r in auto.values()) <= {"chi2", "firth", "fisher"}
    logit = rows(assoc.single_locus_scan(gt, s, "logistic"))
    x, b = np.column_stack([np.ones(400), g[5]]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (case - p))
    assert logit[5]["beta"] == pytest.approx(b[1], rel=1e-6)
    adjusted = rows(assoc.linear_scan_adjusted(gt, s.withColumn("c", F.col("s") % 7), ["c"]))
    x = np.column_stack([np.ones(400), np.arange(400) % 7, g[3]])
    assert adjusted[3]["beta"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][2])


def test_firth_leverages_sum_to_the_parameters():
    # The hat values of two parameters sum to two; a factor used the wrong way round would not.
    cells = np.array([[3, 0, 0, 40, 10, 2]])
    out = assoc.logistic_from_counts(cells, firth=True)[0]
    assert np.isfinite(out).all() and out[0] < 0 and 0 < out[2] <= 1
    null = assoc.logistic_from_counts(np.array([[10, 0, 0, 10, 0, 0]]), firth=True)[0]
    assert null[0] == 0 and null[2] == 1


def test_chi2_with_zero_margin_is_null(spark):
    c = spark.createDataFrame([(1, 5, 0, 0, 5, 0, 0)], "v long, case_hr long, case_het long, case_ha long, ctrl_hr long, ctrl_het long, ctrl_ha long")
    r = assoc.chi2_allelic(c).first()
    assert (r["chi2"], r["p_value"], r["odds_ratio"], r["beta"]) == (0.0, 1.0, 1.0, 0.0)


def test_packed_genotypes_and_missing(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 2])], "v long, c array<tinyint>").select("v", genotype.pack_genotypes("c").alias("gt_packed"))
    assert df.select(genotype.unpack_genotypes("gt_packed")).first()[0][:5] == [0, 1, 2, 3, 2]
    s = spark.createDataFrame([(10 + k, k) for k in range(5)], "s long, packed_index int")
    got = {(r["s"], r["g"]) for r in genotype.explode_packed(df, s).collect()}
    assert got == {(11, 1), (12, 2), (13, None), (14, 2)}
    counts = genotype.count_tables(genotype.explode_packed(df, s), s.select("s", (F.col("s") < 13).alias("is_case"))).first()
    assert tuple(counts)[1:] == (1, 1, 1, 0, 0, 1) or counts.asDict() == {"v": 1, "case_hr": 1, "case_het": 1, "case_ha": 1, "ctrl_hr": 0, "ctrl_het": 0, "ctrl_ha": 1}


def test_ld_is_pairwise_complete(spark, panel):
    g, _, _, gt, _, variants = panel
    got = {(r["v1"], r["v2"]): r["r"] for r in genotype.ld_pairs(gt, variants, 400).collect()}
    assert len(got) == 66
    assert all(r == pytest.approx(np.corrcoef(g[a], g[b])[0, 1], abs=1e-9) for (a, b), r in got.items())
    x = g[:2].astype(float)
    x[0, :30], x[1, 20:50] = np.nan, np.nan
    miss = spark.createDataFrame([(v, s, None if np.isnan(x[v, s]) else int(x[v, s])) for v in range(2) for s in range(400) if np.isnan(x[v, s]) or x[v, s]], "v long, s long, g int")
    ok = ~np.isnan(x).any(0)
    assert genotype.ld_pairs(miss, variants.where("v < 2"), 400).first()["r"] == pytest.approx(np.corrcoef(x[0, ok], x[1, ok])[0, 1], abs=1e-9)


def test_same_position_variants_are_all_returned(spark):
    v = spark.createDataFrame([(k, 1, 100) for k in range(50)], "v long, chr int, pos long")
    assert genotype.region(v, 1, 100, 100).count() == 50


def locus(spark, seed=1, n=20):
    rng = np.random.default_rng(seed)
    r2 = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
    r2 = np.exp(-0.4 * r2)
    z = np.abs(rng.standard_normal(n)) + 4 * r2[n // 2]
    c = spark.createDataFrame([("a", k, float(z[k])) for k in range(n)] + [("b", 100 + k, 1.0) for k in range(2)], "locus string, v long, z double")
    ld = spark.createDataFrame([("a", i, j, float(r2[i, j]), float(r2[i, j] ** 0.5)) for i in range(n) for j in range(i + 1, n)], "locus string, v1 long, v2 long, r2 double, r double")
    return z, r2, c, ld


def test_finemapping_against_loops(spark):
    z, r2, c, ld = locus(spark)
    u = np.array([z[i] - np.mean([r2[i, j] * z[j] for j in range(20) if j != i and r2[i, j] > 0.3]) for i in range(20)])
    u = np.maximum(u / u.max() * z.max(), 0)
    pip = np.exp(0.5 * u - (0.5 * u).max())
    pip /= pip.sum()
    got = rows(finemap.gafm(c, ld))
    assert set(got) == set(range(20))  # two variants are no locus
    assert [got[k]["pip"] for k in range(20)] == pytest.approx(pip.tolist())
    order = np.argsort(-pip)
    k = int(np.searchsorted(np.cumsum(pip[order]), 0.95)) + 1
    assert {v for v in got if got[v]["in_credible_set"]} == set(order[:k].tolist())
    mx = rows(finemap.gafm_mx(c, ld, 400))
    assert sum(r["pip"] for r in mx.values()) == pytest.approx(1, abs=1e-6) and max(mx, key=lambda v: mx[v]["pip"]) == int(np.argmax(u))
    empty = spark.createDataFrame([], "v long, genes array<string>, pathways array<string>, ppi array<string>")
    no_genes = rows(finemap.hbp(c, ld, empty))
    soft = np.exp(u - u.max()) / np.exp(u - u.max()).sum()
    assert [no_genes[k]["pip"] for k in range(20)] == pytest.approx(soft.tolist())
    ann = spark.createDataFrame([(3, ["G"], ["P"], []), (4, ["H"], ["P"], ["G"])], "v long, genes array<string>, pathways array<string>, ppi array<string>")
    with_genes = rows(finemap.hbp(c, ld, ann))
    assert sum(r["pip"] for r in with_genes.values()) == pytest.approx(1) and with_genes[3]["pip"] > no_genes[3]["pip"]
    both = rows(finemap.ensemble(finemap.gafm_mx(c, ld, 400), finemap.hbp_mx(c, ld, ann, 400)))
    assert sum(r["pip"] for r in both.values()) == pytest.approx(1, abs=1e-6)
    paths = spark.createDataFrame([(3, "P")], "v long, pathway string")
    assert sum(r["pip"] for r in rows(finemap.cross_locus(c, ld, paths)).values()) == pytest.approx(1)
    sparse = rows(finemap.sparse_deconvolution(c.where("locus = 'a'").withColumn("se", F.lit(1.0)), ld))
    assert sum(r["pip"] for r in sparse.values()) == pytest.approx(1)
    emb = rows(finemap.embedding(c.where("locus = 'a'"), ld, eps=1.5))
    assert sum(r["pip"] for r in emb.values()) == pytest.approx(1)


def test_results_do_not_depend_on_partitions(spark, panel):
    _, _, _, gt, s, variants = panel
    a = rows(assoc.linear_scan(gt.repartition(1), s))
    b = rows(assoc.linear_scan(gt.repartition(7), s.repartition(3)))
    assert all(a[v]["t"] == pytest.approx(b[v]["t"], rel=1e-9) for v in a)
    x = rows(simulate.causal(gt.repartition(2), s, {1: 0.5}), "s")
    y = rows(simulate.causal(gt.repartition(5), s.repartition(3), {1: 0.5}), "s")
    assert all(x[k]["y"] == pytest.approx(y[k]["y"]) for k in x)


def test_graph_algorithms(spark):
    path = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0)]
    assert graph.betweenness(graph.adjacency(path))[3] == pytest.approx(4 / 6)
    assert graph.betweenness(graph.adjacency(path), weighted=True)[3] == pytest.approx(4 / 6)
    two = [(a, b, 1.0) for a in range(5) for b in range(a)] + [(a + 10, b + 10, 1.0) for a in range(5) for b in range(a)] + [(0, 10, 0.1)]
    part = graph.louvain(graph.adjacency(two))
    assert len({part[k] for k in range(5)}) == len({part[k + 10] for k in range(5)}) == 1 and part[0] != part[10]
    value, cut = graph.max_flow([("s", "a", 3), ("s", "b", 2), ("a", "b", 1), ("a", "t", 2), ("b", "t", 3)], "s", "t")
    assert value == 5 and sum({("s", "a"): 3, ("s", "b"): 2, ("a", "t"): 2, ("b", "t"): 3, ("a", "b"): 1}[e] for e in cut) == 5
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    pr = rows(graph.pagerank(e.withColumn("w", F.lit(1.0))), "node")
    assert sum(r["rank"] for r in pr.values()) == pytest.approx(1) and pr[2]["rank"] > pr[1]["rank"]
    assert graph.independent_set(graph.adjacency(path), [2, 1, 3, 4, 5]) == [2, 4]


def test_random_walk_matches_dense(spark):
    edges = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (2, "c")], "v long, gene string")
    step = rwr.transition(rwr.bipartite(edges))
    m = np.zeros((4, 4))
    for r in step.collect():
        m[r["i"], r["j"]] = r["p"]
    assert m.sum(1) == pytest.approx([1] * 4)
    got = {(r["seed"], r["v"]): r["p"] for r in rwr.walk(step, edges.select("v").distinct(), rounds=50).collect()}
    for s in range(4):
        want = rwr.dense_walk(m, s)
        assert [got.get((s, v), 0.0) for v in range(4)] == pytest.approx(want.tolist(), abs=1e-4)
        assert sum(got.get((s, v), 0.0) for v in range(4)) == pytest.approx(1)
    with pytest.raises(ValueError):
        rwr.walk(step, edges.select("v"), alpha=0)


def test_interactions_and_corrections(spark, panel):
    g, y, _, gt, s, _ = panel
    pairs = spark.createDataFrame([(0, 1), (3, 4), (5, 6)], "v1 long, v2 long")
    got = {(r["v1"], r["v2"]): r for r in epistasis.test_interactions(gt, s, pairs).collect()}
    for a, b in got:
        x = np.column_stack([np.ones(400), g[a], g[b], g[a] * g[b]])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        res = y - x @ beta
        se = math.sqrt(res @ res / 396 * np.linalg.inv(x.T @ x)[3, 3])
        assert got[a, b]["beta"] == pytest.approx(beta[3]) and got[a, b]["se"] == pytest.approx(se)
    p = spark.createDataFrame([(k, k + 1, v) for k, v in enumerate([0.01, 0.04, 0.03, 0.5])], "v1 long, v2 long, p_value double")
    bh = {r["v1"]: r["p_corrected"] for r in epistasis.benjamini_hochberg(p).collect()}
    assert [bh[k] for k in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    # Corrected by the final number of pairs, whatever their order.
    d = epistasis.differential(gt, s, spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "v1 long, v2 long"))
    assert all(r["p_corrected"] >= r["fisher"] for r in d.collect())


def test_direct_and_partner_motifs(spark):
    vg = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "v long, gene string")
    ppi = spark.createDataFrame([("A", "C"), ("B", "C")], "a string, b string")
    partner = {(r["v1"], r["v2"]) for r in epistasis.motif_pairs("protein_interaction", vg, ppi=ppi).collect()}
    direct = {(r["v1"], r["v2"]) for r in epistasis.motif_pairs("protein_interaction", vg, ppi=ppi, direct=True).collect()}
    assert partner == {(1, 2)} and direct == {(1, 3), (2, 3)}


def test_mr_recovers_a_planted_effect(spark):
    rng = np.random.default_rng(3)
    bx = rng.uniform(0.1, 0.5, 40)
    b = 0.5 * bx + rng.normal(0, 0.01, 40)
    i = spark.createDataFrame([(k, float(bx[k]), 0.01, float(b[k]), 0.01) for k in range(40)], "v long, bx double, sx double, by double, sy double")
    assert mr.ivw(i).first()["estimate"] == pytest.approx(0.5, abs=0.02)
    e = mr.egger(i).first()
    assert e["estimate"] == pytest.approx(0.5, abs=0.05) and abs(e["intercept"]) < 0.02
    m = mr.weighted_median(i).first()
    assert m["estimate"] == pytest.approx(mr.weighted_median_of(b / bx, (bx / 0.01) ** 2))
    assert mr.weighted_median_se(i, 100).first()["se"] > 0
    x = spark.createDataFrame([(1, 0.5, 0.1, 1e-9), (2, 0.4, 0.1, 1e-10), (3, 0.3, 0.1, 0.5)], "v long, beta double, se double, p_value double")
    ld = spark.createDataFrame([(1, 2, 0.9)], "v1 long, v2 long, r2 double")
    assert [r["v"] for r in mr.select_instruments(x, x, ld).collect()] == [2]


def test_scores_and_auroc(spark, panel):
    g, _, case, gt, s, _ = panel
    w = spark.createDataFrame([(5, 0.7, 1e-9), (1, 0.2, 0.5)], "v long, beta double, p_value double")
    got = rows(prs.classical(gt, w, s), "s")
    assert all(got[k]["score"] == pytest.approx(0.7 * g[5, k]) for k in range(400))
    sc = spark.createDataFrame([(k, float(g[5, k]), bool(case[k])) for k in range(400)], "s long, score double, is_case boolean")
    a, b = g[5][case], g[5][~case]
    want = np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None]))
    assert prs.auroc(sc).first()["auroc"] == pytest.approx(want)
    r = prs.evaluate(sc).first()
    assert 0 < r["nagelkerke_r2"] < 1 and r["decile_or"] > 1
    ld = spark.createDataFrame([(5, 1, 0.9)], "v1 long, v2 long, r2 double")
    assert [x["v"] for x in prs.prune(w, ld, 1.0).collect()] == [5]


def test_trials(spark):
    obs = [(g, f"L{e}_20{e:02d}", 1, 1.0 * g + 0.5 * e + 0.3 * ((g * e) % 3)) for g in range(12) for e in range(5) if (g, e) != (2, 3)]
    df = spark.createDataFrame(obs, "genotype long, environment string, rep int, value double")
    r = met.gxe(df).first()
    assert r["var_g"] > r["var_e"] > 0 and r["h2"] + r["gxe_share"] < 1
    v = met.impute(df, 2, "L3_2003").first()["value"]
    assert math.isfinite(v)
    dims = met.dimensions(df)
    assert {x["year"] for x in dims["environments"].collect()} == {2000, 2001, 2002, 2003, 2004}
    d = met.design(df)
    assert d["components"].first()["n_components"] == 1 and d["balance"].first()["n_cells"] == 59
    assert met.mega_environments(df, min_shared=5).count() == 5
    assert met.gxe(df.limit(0)).count() == 0


def test_structure(spark, panel):
    g, y, _, gt, s, _ = panel
    ids, k = structure.dense(structure.grm(gt, s), s)
    af = g.mean(1) / 2
    z = (g - 2 * af[:, None]) / np.sqrt(2 * af * (1 - af))[:, None]
    assert np.abs(k - z.T @ z / 12).max() < 1e-8
    values, pcs = structure.pca(k, 3)
    assert values[0] >= values[1] >= values[2] and pcs.shape == (400, 3)
    fit = structure.residualise(y, np.eye(400))
    assert len(fit["residuals"]) == 400
    sim = structure.similarity(gt, 400, 0.6)
    ids, w = structure.dense(sim, s)
    carriers = g > 0
    use = [v for v in range(12) if af[v] < 0.6 and carriers[v].sum() >= 2]
    want = sum(np.outer(carriers[v], carriers[v]) / af[v] for v in use) / len(use)
    assert np.abs(w - want).max() < 1e-8
    lam, vec = structure.laplacian_spectrum(w, 5)
    assert abs(lam[0]) < 1e-8
    h = structure.spectral_heritability(lam, vec, y)
    assert 0 <= h["h2"] <= 1
    assert structure.liability_h2(0.5, 0.1) == 0 and 0 < structure.liability_h2(0.6, 0.1) < structure.liability_h2(0.7, 0.1)
    r = structure.conductance_heritability(gt, s, 0.6, 10).first()
    assert 0 <= r["h2"] <= 1 and 0 < r["p_value"] <= 1
    names, gm, rg = multivariate.g_matrix(lam, vec, {"a": y, "b": -y})
    assert rg[0, 1] == pytest.approx(-1)


def test_flow_permutation_is_not_degenerate(spark, panel):
    _, _, _, gt, s, _ = panel
    vg = spark.createDataFrame([(v, f"g{v % 3}", "HIGH") for v in range(12)], "v long, gene string, impact string")
    gp = spark.createDataFrame([("g0", "P"), ("g1", "P"), ("g2", "Q")], "gene string, pathway string")
    t = flow.test_flows(gt, s, vg, gp, 0.9, 5).collect()
    assert {r["pathway"] for r in t} == {"P", "Q"} and all(0 < r["p_value"] <= 1 for r in t)
    h = flow.heritability(gt, s, vg, gp, 0.9, 5).collect()
    assert sum(r["fraction"] for r in h) == pytest.approx(1) and 0 <= h[0]["h2_total"] <= 1
    assert len(flow.architecture(flow.test_flows(gt, s, vg, gp, 0.9, 2), 2.0).first()["pathways"]) == 2


def test_gene_tests_and_bias(spark):
    z = spark.createDataFrame([("G", 1, 2.0), ("G", 2, 3.0), ("H", 3, 1.0)], "gene string, v long, z double")
    ld = spark.createDataFrame([(1, 2, 0.5)], "v1 long, v2 long, r double")
    d = gene_tests.directed(z, ld).first()
    assert d["stat"] == pytest.approx(5 / math.sqrt(3))
    u = gene_tests.undirected(z, spark.createDataFrame([(1, 2, 0.0)], "v1 long, v2 long, r double")).first()
    assert u["p_value"] == pytest.approx(math.exp(-13 / 2), rel=1e-6)
    rng = np.random.default_rng(0)
    g = rng.standard_normal(200)
    assert bias.rho_max(g, g) == pytest.approx(1) and 0 < bias.rho_max(g, rng.standard_normal((200, 2))) < 0.4
    assert bias.conservativeness(5.0, 1000, 0.0, 0.3) == pytest.approx(1)
    with pytest.raises(ValueError):
        bias.mu_shift(F.lit(0.1), 1.0, 10)


def test_sumstats(spark):
    df = spark.createDataFrame([("1", 100, "A", "G", 0.5, 0.1, 1e-8), ("1", 200, "A", "G", 0.4, 0.0, 0.05), ("1", 900_000, "C", "T", 0.3, 0.1, 1e-9), ("1", 300, "C", "T", None, None, None)], "chr string, pos long, ref string, alt string, beta double, se double, pval double")
    z = {r["pos"]: r["z"] for r in sumstats.with_z(df).collect()}
    assert z[100] == pytest.approx(5) and z[200] == pytest.approx(1.959964, rel=1e-5) and z[300] == 0
    assert [r["pos"] for r in sumstats.clump(sumstats.significant(df, 1e-5)).orderBy("rank").collect()] == [900_000, 100]
    one = spark.createDataFrame([("chr1:5:A:G", 2.0), ("1:6:T:C", 3.0), ("1:7:A:C", 1.0)], "variant_id string, z double")
    ref = spark.createDataFrame([("1:5:A:G", 0), ("1:6:C:T", 1)], "variant_id string, idx int")
    assert {(r["idx"], r["flip"], r["z"]) for r in sumstats.align_to_ld(one, ref).collect()} == {(0, 1, 2.0), (1, -1, -3.0)}


def test_store_is_idempotent(spark, tmp_path):
    r = spark.createDataFrame([("a", 0.1, 0.5)], "variant_id string, beta double, p_value double")
    for _ in range(2):
        store.store_results(r, str(tmp_path), "r1", "t")
        store.create_study(spark, str(tmp_path), "r1", "t", "chi2", 1, 2, 3)
    store.store_results(r, str(tmp_path), "r2", "t")
    assert spark.read.parquet(f"{tmp_path}/association_result").count() == 2
    assert store.delete_run(spark, str(tmp_path), "r1") == 1
    assert spark.read.parquet(f"{tmp_path}/association_result").count() == 1
    with pytest.raises(ValueError):
        store.run_sql(spark, "DROP TABLE x", {})
    with pytest.raises(ValueError):
        store.run_sql(spark, "select 1; drop table x", {})
    assert store.run_sql(spark, "select count(*) n from r", {"r": r}).first()["n"] == 1
    for q in (
        "FROM r INSERT OVERWRITE DIRECTORY '/tmp/none' USING parquet SELECT *", "WITH t AS (SELECT 1) INSERT OVERWRITE DIRECTORY '/tmp/none' USING parquet SELECT * FROM t", "WITH t AS (SELECT 1) INSERT INTO r SELECT * FROM t",
        "SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT max(a) FROM csv.`/tmp/x`) FROM r", "WITH t AS (SELECT * FROM text.`/etc/hosts`) SELECT * FROM t", "SELECT * FROM other", "SELECT reflect('java.lang.System', 'exit', 1)", "CACHE TABLE r", "VALUES (1); SELECT 2",
    ):
        with pytest.raises(ValueError, match="allowed|tables of the store"):
            store.run_sql(spark, q, {"r": r})
    ok = ("WITH t AS (SELECT * FROM r), u AS (SELECT * FROM t) SELECT * FROM u UNION ALL SELECT * FROM R ORDER BY 1;", "FROM r SELECT *", "VALUES (1), (2)", "SELECT * FROM r WHERE EXISTS (SELECT 1 FROM r x) GROUP BY ALL HAVING count(*) > 0", "SELECT k FROM range(2) t(k)")
    assert [store.run_sql(spark, q, {"r": r}).count() for q in ok] == [2, 1, 2, 1, 2]
    assert store.check_schema({"r": r}, {"r": ["beta", "x"], "q": []}) == ["r has no column x", "table q is missing"]


def test_phenotypes(spark):
    wide = spark.createDataFrame([("s1", "1.5", "case"), ("s2", "", "control"), ("s3", "x", "other")], "id string, `plant height` string, st string")
    long = store.long_phenotypes(wide, "id")
    assert {(r["sample_id"], r["trait"], r["num"]) for r in long.collect() if r["trait"] == "plant_height"} == {("s1", "plant_height", 1.5), ("s3", "plant_height", None)}
    assert {(r["s"], r["is_case"]) for r in store.activate(long, "st", "case", "control").collect()} == {("s1", True), ("s2", False), ("s3", None)}


def test_readers(spark, tmp_path):
    from strandline.sources import readers as R

    def put(name, text):
        p = tmp_path / name
        (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w")).write(text)
        return str(p)

    gtf = put("g.gtf.gz", '#!x\nchr1\tH\tgene\t5\t90\t.\t+\t.\tgene_id "ENSG1.7"; gene_type "protein_coding"; gene_name "AB";\nchr1\tH\texon\t5\t9\t.\t+\t.\tgene_id "ENSG1.7";\nchr2\tH\tgene\t1\t2\t.\t-\t.\tgene_id "ENSG2.1"; gene_type "lincRNA"; gene_name "CD";\n')
    assert [tuple(r) for r in R.gtf_genes(spark, gtf).collect()] == [("ENSG1", "AB", "chr1", 5, 90, "+", "protein_coding")]
    glm = put("x.glm", "#CHROM\tPOS\tID\tREF\tALT\tA1\tTEST\tOBS_CT\tBETA\tSE\tP\n1\t10\trs1\tA\tG\tG\tADD\t100\t0.5\t0.1\t0\n1\t20\tchr1:20:C:T\tC\tT\tC\tADD\t100\t0.5\t0.1\t0.01\n1\t30\trs3\tA\tG\tG\tDOM\t1\t1\t1\t1\n")
    got = {r["variant_id"]: (r["beta"], r["p_value_log10"]) for r in R.plink_glm(spark, glm).collect()}
    assert got == {"chr1:10:A:G": (0.5, 300.0), "chr1:20:C:T": (-0.5, 2.0)}
    reg = put("x.regenie", "CHROM GENPOS ID ALLELE0 ALLELE1 A1FREQ N BETA SE LOG10P\n1 10 rs A G 0.2 100 0.3 0.1 3\n1 11 rs A G 0.2 100 NA NA NA\n")
    r = R.regenie(spark, reg).collect()
    assert len(r) == 1 and r[0]["p_value"] == pytest.approx(1e-3)
    pan = put("p.tsv.gz", "chr\tpos\tref\talt\tbeta_EUR\tse_EUR\tneglog10_pval_EUR\tlow_confidence_EUR\tbeta_AFR\tse_AFR\n1\t5\tA\tG\t0.2\t0.1\t2\tfalse\tNA\tNA\n1\t6\tA\tG\t0.2\t0.1\t3\ttrue\t0.1\t0.1\n1\t7\tA\tG\t0.2\t0.1\t1\tfalse\t0.1\t0.2\n")
    assert [r["pos"] for r in R.panukb(spark, pan, p_threshold=0.01).collect()] == [5]  # an equal p stays
    assert {(r["ancestry"], r["pos"]) for r in R.panukb_locus(spark, pan, "1", 5, 6).collect()} == {("EUR", 5), ("EUR", 6), ("AFR", 6)}
    assert R.panukb_file_name("50", "continuous", None, "irnt") == "continuous-50-both_sexes-irnt.tsv.bgz"
    cache = put("c.json", json.dumps({"v1": {"genes": ["A"], "pathways": [{"name": "P"}], "ppi": [], "prior_score": 0.5}}))
    assert tuple(R.graph_cache(spark, cache).first()) == ("v1", ["A"], ["P"], [], 0.5)
    vcf = put("x.vcf", "##f\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n1\t10\t.\tA\tG\t.\t.\tCAUSAL\tGT\t0/1\t1|1\t./.\n")
    v, g = R.vcf(spark, vcf)
    assert v.first()["variant_id"] == "1:10:A:G" and {(r["sample"], r["g"]) for r in g.collect()} == {("a", 1), ("b", 2), ("c", None)}
    links, info = put("l.txt.gz", "protein1 protein2 combined_score\np1 p2 900\np2 p1 800\np1 p1 999\np1 p3 100\n"), put("i.tsv", "#id\tname\np1\tA\np2\tB\np3\tC\n")
    assert [tuple(r) for r in R.string_ppi(spark, links, info).collect()] == [("A", "B", 900)]
    ev = put("e.eigenvec", "#FID IID PC1 PC2\nf s1 0.1 0.2\n")
    assert {tuple(r) for r in R.eigenvec(spark, ev).collect()} == {("s1", "pca_1", 0.1), ("s1", "pca_2", 0.2)}
    np.savez(tmp_path / "r.npz", R=np.array([[1.0, 0.5], [0.5, 1.0]]))
    assert R.ld_npz(spark, str(tmp_path / "r.npz")).first()["r2"] == 0.25
    pav = spark.createDataFrame([("s1", "1", "0"), ("s2", "0", "0")], "strain string, g1 string, g2 string")
    assert {r["v"] for r in sv.long_matrix(pav, "strain", "pav").collect()} == {"pav_g1"}


def test_quality_control(panel):
    _, _, _, gt, s, _ = panel
    q = qc.variant_qc(gt, s).collect()
    assert len(q) == 12 and all(0 < r["hwe_pvalue_controls"] <= 1 for r in q)
    miss = gt.union(s.where("s = 7").select(F.explode(F.array(*[F.lit(100 + k).cast("long") for k in range(3)])), "s", F.lit(None).cast("int")))
    out = rows(qc.sample_qc(miss, s, 15), "s")
    assert out[7]["is_excluded_qc"] and "missingness" in out[7]["exclusion_reason"] and out[7]["genotype_missingness"] == pytest.approx(0.2)


def test_interval_join_keeps_each_pair_once(spark):
    p = spark.createDataFrame([(1, k * 40_000) for k in range(20)], "chr int, pos long")
    i = spark.createDataFrame([(1, 10_000, 500_000, "wide"), (1, 90_000, 90_001, "point")], "chr int, start long, end long, name string")
    got = intervals.interval_join(p, i, 12_000).collect()
    assert len(got) == len({(r["pos"], r["name"]) for r in got}) == sum(-2_000 <= k * 40_000 <= 512_000 for k in range(20)) + 1
    assert {r["distance_bp"] for r in got if r["name"] == "point"} == {10_000}


def test_reports(spark, panel):
    from strandline.operators import graph_export, reports

    _, _, _, gt, s, variants = panel
    vg = variants.select("v", (F.col("v") % 4).alias("gene"))
    gp = spark.createDataFrame([(0, "P"), (1, "P"), (2, "Q"), (3, "Q")], "gene long, pathway string")
    h = reports.heritability(gt, s, vg, gp, 0.6, 6)
    assert all(0 <= x <= 1 for x in h["h2"].values()) and set(h["shares"]) == {"pathway", "gene_specific", "variant_specific"}
    two = s.withColumn("y2", -F.col("y"))
    assert reports.bivariate(gt, two, ["y", "y2"], 0.6, 6)["pair"]["r_g"] == pytest.approx(-1)
    r = reports.multiresolution_correlation(gt, two, ("y", "y2"), vg, gp, 0.6, 6)
    assert all(v == pytest.approx(-1) for v in r.values())
    assert reports.spectral_components(gt, s, 0.6, 3).count() == 1200
    out, info = structure.corrected_scan(gt, s, "pca+", 2)
    assert out.count() == 12 and info["factor"] > 0
    auto = structure.corrected_scan(gt, s, "auto", 2)[1]
    assert auto["method"] in ("none", "pca", "mixed")
    g = graph_export.export(gt, s, variants, vg)
    f = graph_export.neighbour_features(g)
    assert f.count() == 400 and "label" in f.columns
    scored = graph_export.linear_substitute(f)
    assert 0 < scored.count() < 150 and prs.auroc(scored).first()["auroc"] > 0.4
    edges = rwr.bipartite(vg)
    pairs = rwr.gene_pair_scores(edges.union(spark.createDataFrame([(0, 1, 1.0)], "v long, gene long, w double")), vg.select("gene").distinct(), rounds=10).collect()
    assert {(p["a"], p["b"]) for p in pairs} == {(0, 1)}


def test_tails_as_columns_equal_the_exact_ones(spark):
    import random

    rng = random.Random(1)
    rows = [(abs(rng.gauss(0, 3)), float(rng.choice([1, 2, 3, 7, 19, 20, 60, 1498]))) for _ in range(150)] + [(0.0, 5.0), (float("nan"), 5.0), (2.0, 0.0), (None, 4.0)]
    for r in spark.createDataFrame(rows, "t double, df double").withColumn("p", S.t_p("t", "df")).collect():
        want = S.t_two_sided(r["t"], r["df"]) if r["t"] is not None and r["t"] == r["t"] and r["df"] > 0 else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-5)
    cells = [tuple(rng.randrange(0, 80) for _ in range(4)) for _ in range(60)] + [(0, 5, 0, 7), (3, 0, 0, 3)]
    for r in spark.createDataFrame(cells, "a long, b long, c long, d long").withColumn("p", S.fisher_p("a", "b", "c", "d")).collect():
        assert r["p"] == pytest.approx(S.fisher_two_sided(r["a"], r["b"], r["c"], r["d"]), rel=1e-9)
    counts = [(h, a, h + a + rng.randrange(a, 200)) for h in range(0, 40, 7) for a in range(0, 16, 5)] + [(0, 0, 0)]
    for r in spark.createDataFrame(counts, "h long, a long, n long").withColumn("p", S.hwe_p("h", "a", "n")).collect():
        assert r["p"] == pytest.approx(S.hwe_exact(r["h"], r["a"], r["n"]), rel=1e-9)
    for r in spark.createDataFrame([(k, 0.3 + k / 2) for k in range(30)], "k long, mu double").withColumn("p", S.poisson_p("k", "mu")).collect():
        assert r["p"] == pytest.approx(S.poisson_cdf(r["k"], r["mu"]), rel=1e-9)


def test_corrections_over_many_ranges(spark):
    import random

    from strandline.operators.epistasis import benjamini_hochberg, bonferroni

    rng = random.Random(2)
    p = [rng.random() ** 3 for _ in range(700)] + [1.0] * 200 + [0.01] * 50 + [None]
    df = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate(p)], "v1 long, v2 long, p_value double")
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, least = {}, 1.0
    for k in range(len(known), 0, -1):
        least = min(least, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = least
    got = {r["v1"]: r["p_corrected"] for r in benjamini_hochberg(df).collect()}
    assert len(got) == len(p) and got[len(p) - 1] is None and all(got[i] == pytest.approx(x) for i, x in want.items())
    assert {r["p_corrected"] for r in bonferroni(df).where("p_value = 1").collect()} == {1.0}


def test_interaction_matrix_has_every_sample(spark):
    from strandline.operators.epistasis import interaction_matrix

    g = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 1, 1)], "v long, s long, g int")
    s = spark.createDataFrame([(k,) for k in range(5)], "s long")
    out = interaction_matrix(g, s, spark.createDataFrame([(1, 2)], "v1 long, v2 long"))
    rows = {r["s"]: r["x"] for r in out.collect()}
    assert set(rows) == set(range(5)) and rows[1] == pytest.approx((2 - 0.6) * (1 - 0.2)) and rows[4] == pytest.approx(0.6 * 0.2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interactions_with_covariates(spark):
    from strandline.operators.epistasis import test_interactions as interactions

    rng = np.random.default_rng(11)
    n = 300
    g = rng.binomial(2, 0.4, (3, n))
    c = np.column_stack([rng.normal(1000, 300, n), rng.integers(0, 3, n)])
    y = 0.3 * g[0] - 0.2 * g[1] + 0.5 * g[0] * g[1] + 0.002 * c[:, 0] + rng.normal(size=n)
    genos = spark.createDataFrame([(v, s, int(g[v, s])) for v in range(3) for s in range(n) if g[v, s]], "v long, s long, g int")
    people = spark.createDataFrame([(s, float(y[s]), float(c[s, 0]), float(c[s, 1])) for s in range(n)] + [(n, 5.0, None, 1.0)], "s long, y double, age double, site double")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "v1 long, v2 long")
    for names, extra in (((), np.zeros((n, 0))), (("age", "site"), c)):
        got = {(r["v1"], r["v2"]): r for r in interactions(genos, people.where("s < 300"), pairs, names).collect()}
        for a, b in got:
            x = np.column_stack([np.ones(n), extra, g[a], g[b], g[a] * g[b]])
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            r = y - x @ beta
            se = math.sqrt(r @ r / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[-1, -1])
            row = got[a, b]
            assert (row["beta1"], row["beta2"], row["beta"], row["se"]) == pytest.approx((*beta[-3:], se), rel=1e-6)
            assert row["p_value"] == pytest.approx(S.t_two_sided(abs(beta[-1] / se), n - x.shape[1]), rel=1e-4)
    assert len(interactions(genos, people, pairs, ("age",)).collect()) == 3
