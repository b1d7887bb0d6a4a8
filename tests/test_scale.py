"""Steps whose cost must not grow faster than their input, against plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import genotype, tiles


def test_pairs_in_tiles_equal_a_loop_whatever_the_cut(spark):
    rng = np.random.default_rng(3)
    dense = {(f"v{v:02d}", s): int(g) for v in range(40) for s in range(60) if (g := rng.integers(0, 3)) and (v % 3 == 0 or rng.random() < 0.1)}
    rows = spark.createDataFrame([(v, s, g) for (v, s), g in dense.items()], "v string, s long, g int")
    names = sorted({v for v, _ in dense})
    pairs = [(a, b) for a in names for b in names if a < b and (ord(a[2]) + ord(b[2])) % 2]
    want = {(a, b): (sum(dense[a, s] * dense[b, s] for s in range(60) if (a, s) in dense and (b, s) in dense), sum(dense[a, s] ** 2 * dense[b, s] for s in range(60) if (a, s) in dense and (b, s) in dense)) for a, b in pairs}
    want = {k: x for k, x in want.items() if any(x)}
    for side, entries in ((7, 10**6), (16, 40)):
        got = tiles.pair_products(spark.createDataFrame(pairs, "v1 string, v2 string"), rows, {"g": F.col("g"), "q": F.col("g") * F.col("g")}, {"x": ("g", "g"), "y": ("q", "g")}, side, entries)
        assert {(r["v1"], r["v2"]): (r["x"], r["y"]) for r in got.collect()} == want


@pytest.mark.parametrize("share", [0.01, 0.9])
def test_crossed_sums_of_thin_and_dense_tiles(share):
    rng = np.random.default_rng(1)
    grids = [(rng.random((8, 3000)) < share) * rng.integers(1, 3, (8, 3000)) for _ in range(2)]
    sides = [{"o": o, "s": s * 7, "g": g[o, s].astype(float)} for g in grids for o, s in [np.nonzero(g)]]
    assert (tiles._crossed(*sides, {"x": ("g", "g")}, 8)[0] == grids[0] @ grids[1].T).all()


def test_rows_sent_for_pairs_do_not_grow_with_the_samples(spark):
    """Carriers that are few among many samples: what is written for a variant is its carriers, no block of all samples."""
    rows = spark.createDataFrame([(v, s * 50_000, 1) for v in range(20) for s in range(v % 4, 20)], "v long, s long, g int")
    where = spark.createDataFrame([(v, 1, v * 10) for v in range(20)], "v long, chr int, pos long")
    seen, real = Counter(), tiles.written
    tiles.written = lambda df: seen.update(binary=sum(t == "binary" for _, t in df.dtypes)) or real(df)
    try:
        assert genotype.ld_pairs(rows, where, 1_000_000, 50).count() == sum(min(5, 19 - v) for v in range(20))
    finally:
        tiles.written = real
    assert seen["binary"] == 0


def test_evaluation_runs_its_scores_once(spark):
    from strandline.operators import prs

    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(s, bool(rng.random() < 0.4), float(rng.normal())) for s in range(100)], "s long, is_case boolean, x double")
    assert prs.evaluate(rows.select("s", "is_case", F.udf(note, "double")("x").alias("score"))).count() == 1
    assert seen.value == 100


def test_module_permutations_equal_a_loop(spark):
    from strandline.operators import epistasis

    rng = np.random.default_rng(4)
    gt = [(v, s, 1) for v in range(5) for s in range(80) if rng.random() < 0.4]
    case = {s: bool(rng.random() < 0.5) for s in range(100)}
    a, b = sum(case.values()), 100 - sum(case.values())
    got = epistasis.module_permutation(spark.createDataFrame(gt, "v long, s long, g int"), spark.createDataFrame(list(case.items()), "s long, is_case boolean"), spark.createDataFrame([(v, 0) for v in range(5)], "v long, module long"), 50).first()
    who = sorted({s for _, s, _ in gt})
    m = np.zeros((5, len(who)))
    for v, s, _ in gt:
        m[v, who.index(s)] = 1
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    score = lambda c: np.mean([((m[i] * m[j] * c).sum() / a) / ((m[i] * m[j] * (1 - c)).sum() / b + 0.5 / b) for i, j in pairs])
    assert got["score"] == pytest.approx(score(np.array([float(case[s]) for s in who])))
    assert epistasis._labels(42, a, b, len(who), 0, 50) is epistasis._labels(42, a, b, len(who), 0, 50)  # kept, not drawn anew
    labels = epistasis._labels(42, a, b, len(who), 0, 50)
    # Which carrier is which column depends on the order of rows; what a draw gives each number of cases does not.
    assert 1 / 51 <= got["p_value"] <= 1 and labels.shape == (50, len(who)) and (labels.sum(1) <= a).all()


def test_pathway_pairs_need_no_merging(spark):
    from strandline.operators import epistasis

    vg = [(v, v // 2) for v in range(12)]
    gp = [(g, f"N{g % 2}") for g in range(6)] + [(g, f"M{g % 3}") for g in range(6)]
    out = epistasis.motif_pairs("same_pathway", spark.createDataFrame(vg, "v long, gene long"), gene_pathway=spark.createDataFrame(gp, "gene long, pathway string"))
    of = {g: {p for h, p in gp if h == g} for g in range(6)}
    want = {(a, b): min(of[g] & of[h]) for a, g in vg for b, h in vg if a < b and g != h and of[g] & of[h]}
    rows = out.collect()
    assert len(rows) == len(want) and {(r["v1"], r["v2"]): r["entity"] for r in rows} == want
    assert "keys=[v1" not in out._jdf.queryExecution().executedPlan().toString()


def test_logistic_scan_holds_patterns_not_samples(spark):
    from strandline.operators.assoc import fit_logistic, logistic_scan_adjusted

    rng = np.random.default_rng(6)
    n = 600
    x, g = rng.integers(0, 4, n).astype(float), rng.binomial(2, 0.2, n)
    y = (rng.random(n) < 0.3 + 0.1 * g).astype(float)
    people = spark.createDataFrame([(s, bool(y[s]), float(x[s])) for s in range(n)], "s long, is_case boolean, x double")
    got = logistic_scan_adjusted(spark.createDataFrame([(0, s, int(g[s])) for s in range(n) if g[s]], "v long, s long, g int"), people, ["x"], max_bytes=1000).first()
    b, cov, _, good = fit_logistic(np.column_stack([np.ones(n), g, (x - x.mean()) / x.std()]), y, True)
    assert good and got["n"] == n and got["beta"] == pytest.approx(b[1], rel=1e-6) and got["se"] == pytest.approx(cov[1, 1] ** 0.5, rel=1e-6)


def test_graph_features_take_the_limit_of_their_sql(spark, monkeypatch):
    from strandline.operators import graph_export
    from strandline.plans import catalogue

    used, real = [], graph_export.export
    monkeypatch.setattr(graph_export, "export", lambda *a, **k: used.append(k) or real(*a, **k))
    catalogue.QUERIES["graph_export_features"](spark, "/root/testdata/sf0.001")
    assert used == [{"max_variants": 10_000}] and "LIMIT 10000" in catalogue.SQL["graph_export_features"]


def test_no_common_variant_gives_null_components(spark, monkeypatch):
    from strandline.plans import catalogue

    monkeypatch.setattr(catalogue.structure, "standard_variants", lambda g, *a: g.selectExpr("v", "1D AS mean", "1D AS scale").limit(0))
    rows = catalogue.QUERIES["leading_component"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 150 and all(r["pc"] is None and r["eigenvalue"] is None for r in rows)


def test_shared_products_equal_a_loop_whatever_the_cut(spark):
    rng = np.random.default_rng(8)
    has = {(v, s) for v in range(12) for s in range(30) if rng.random() < 0.2}
    weight = {v: float(v + 1) for v in range(12)}
    want = {(i, j): x for i in range(30) for j in range(i, 30) if (x := sum(weight[v] for v in range(12) if (v, i) in has and (v, j) in has))}
    rows = spark.createDataFrame([(v, s, weight[v]) for v, s in has], "v long, s long, x double")
    for side, entries in ((64, 10**6), (7, 10**6), (7, 10)):
        got = tiles.shared_products(rows, "v", "s", "x", side, entries)
        found = got.collect()
        assert len(found) == len(want) and {(r["i"], r["j"]): r["w"] for r in found} == want


def test_similarity_shuffles_no_pairs_of_samples(spark):
    from strandline.operators import structure

    rows = spark.createDataFrame([(v, s, 1) for v in range(3) for s in range(v, 9)], "v long, s long, g int")
    for out in (structure.similarity(rows, 100, 0.5), structure.set_similarity(rows, rows.select("v", F.lit(0).alias("set")).distinct(), 100, 0.5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "keys=[i" not in plan and out.count() == 45


def test_permuted_labels_are_the_least_numbers_of_each_draw(spark):
    import hashlib

    from strandline.operators import structure

    got = structure.permuted_labels(spark.range(70).select(F.col("id").alias("s")), 23, 60, 42).collect()
    assert len(got) == 70 and set(got[0].asDict()) == {"s", "m0", "m1"}
    for d in (0, 49, 50, 59):
        number = lambda s: int(hashlib.md5(f"{s}:{d}:42".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        want = set(sorted(range(70), key=lambda s: (number(s), s))[:23])
        assert {r["s"] for r in got if r[f"m{d // 50}"] >> d % 50 & 1} == want


def test_packed_blocks_follow_the_carriers(spark):
    from strandline.operators import genotype

    rows = [(0, 3, 1), (0, 4001, 2), (1, 9, None), (2, 5002, 1)]
    gt = spark.createDataFrame(rows, "v long, packed_index int, g int")
    packed = genotype.pack_carriers(gt, 5003, 1000)
    assert packed.count() == 4 and packed.agg(F.max(F.length("gt_packed"))).first()[0] == 250
    assert {len(r["gt_packed"]) for r in packed.where("packed_from = 5000").collect()} == {1}
    place = spark.range(5003).select(F.col("id").alias("s"), F.col("id").cast("int").alias("packed_index"))
    assert {tuple(r) for r in genotype.explode_packed(packed, place).collect()} == set(rows)


def test_walks_of_lumps_equal_walks_of_all_variants(spark):
    from strandline.operators import rwr

    rng = np.random.default_rng(4)
    rows = [(v, g) for v in range(60) for g in ({v % 3, 3 + v % 2} if v % 5 else set(rng.integers(0, 6, 3).tolist()))] + [(60, 9), (61, 9), (62, 10)]
    edges = rwr.bipartite(spark.createDataFrame(rows, "v long, gene long"))
    members, lumped = rwr.lumps(edges)
    assert members.select("at").distinct().count() < 25 and members.count() == 63
    for top_k in (7, 40, 5000):
        want = rwr.mutual_pairs(rwr.walk(rwr.factors(edges), edges.select("v").distinct(), rounds=20), top_k).collect()
        walks = rwr.walk(rwr.lump_factors(lumped), members.select("v", "at"), rounds=20)
        assert walks.count() < 25**2  # the walks of all variants have 60 rows for each of 60
        got = rwr.mutual_pairs_of_lumps(walks, members, top_k).collect()
        assert [(r["v1"], r["v2"]) for r in got] == [(r["v1"], r["v2"]) for r in want]
        assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-9)


def test_flows_of_filled_and_scarce_variants_equal_a_maximum_flow(spark):
    """Genes that their carriers fill, genes that compete for few samples, and permuted labels, against Dinic on whole networks."""
    from strandline.operators import flow, graph

    rng = np.random.default_rng(8)
    rows = [(v, s, 1 + int(rng.integers(0, 2))) for v in range(24) for s in range(90) if rng.random() < (0.25 if v < 12 else 0.02) or v > 21 and s == 5]
    g = spark.createDataFrame(rows, "v long, s long, g int")
    samples = spark.createDataFrame([(s, s % 3 != 0) for s in range(90)], "s long, is_case boolean")
    vg = spark.createDataFrame([(v, v // 2, "HIGH" if v % 4 == 0 else "MODERATE") for v in range(24)], "v long, gene long, impact string")
    gp = spark.createDataFrame([(k, f"A{k % 2}") for k in range(12)] + [(k, f"B{k % 5}") for k in range(12)], "gene long, pathway string")
    sent, real = [], flow._split

    def whole(edges):
        by, out = {}, {}
        for r in edges.collect():
            by.setdefault(r["kind"], []).append((r["src"], r["dst"], r["cap"]))
        for name in {b for _, b, _ in by["in_pathway"]}:
            value, cut = graph.max_flow(by["source"] + by["carries"] + by["in_gene"] + [e for e in by["in_pathway"] if e[1] == name], "SOURCE", name)
            genes = {a for a, b, _ in by["in_pathway"] if b == name}
            held = {a for a, b, _ in by["in_gene"] if b in genes}
            own = genes | held | {a for a, b, _ in by["carries"] if b in held} | {name}
            out[name[2:]] = value, sorted({x for e in cut for x in e if x != "SOURCE" and x in own})
        return out

    flow._split = lambda *a, **k: sent.append(real(*a, **k)) or sent[-1]
    try:
        net = flow.network(g, samples.where("is_case"), vg, gp, 90, 0.9)
        got = {r["pathway"]: (r["flow"], r["cut"]) for r in flow.pathway_flows(net).collect()}
    finally:
        flow._split = real
    rich, poor, left = sent[0]
    assert rich.count() and poor.count() and left.count() < net.where("kind = 'carries'").count()
    want = whole(net)
    assert set(got) == set(want)
    for k, (value, cut) in want.items():
        assert got[k][0] == pytest.approx(value) and got[k][1] == cut
    null = {(r["d"], r["pathway"]): r["flow"] for r in flow.observed_and_null(g, samples, vg, gp, 0.9, 3)[1].collect()}
    order = F.xxhash64("s", "d", F.lit(42))
    for d in (1, 2, 3):
        cases = samples.select("s").withColumn("d", F.lit(d)).orderBy(order, "s").limit(60).select("s")
        want = whole(flow.network(g, cases, vg, gp, 90, 0.9))
        assert {p: x for (k, p), x in null.items() if k == d} == pytest.approx({p: x for p, (x, _) in want.items()})


def test_interaction_matrix_shuffles_no_row_of_a_sample(spark, monkeypatch):
    from strandline.operators import epistasis

    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, (3, 70))
    g = spark.createDataFrame([(v, s, int(dense[v, s])) for v in range(3) for s in range(70) if dense[v, s]], "v long, s long, g int")
    s = spark.createDataFrame([(k,) for k in range(70)], "s long")
    out = epistasis.interaction_matrix(g, s, spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "v1 long, v2 long"), 8)
    got = {(r["v1"], r["v2"], r["s"]): r["x"] for r in out.collect()}
    mid = dense - dense.mean(1, keepdims=True)
    assert got == pytest.approx({(a, b, k): mid[a, k] * mid[b, k] for a, b in ((0, 1), (0, 2), (1, 2)) for k in range(70)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(ids") < plan.index("Join")  # samples' rows are made above every join


def test_flow_reads_the_genotypes_twice(spark):
    from strandline.operators import flow

    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(v, s, 1) for v in range(6) for s in range(40) if (v + s) % 3 == 0], "v long, s long, g int")
    noted = rows.select("v", "s", F.udf(note, "int")("g").alias("g"))
    cases = spark.range(0, 40, 2).withColumnRenamed("id", "s")
    genes = spark.createDataFrame([(v, v // 2, "HIGH") for v in range(6)], "v long, gene long, impact string")
    paths = spark.createDataFrame([(k, p) for k in range(3) for p in ("A", "B")], "gene long, pathway string")
    got = flow.pathway_flows(flow.network(noted, cases, genes, paths, 40, 0.5)).collect()
    assert {r["pathway"]: r["flow"] for r in got} == {"A": 3.0, "B": 3.0}
    assert seen.value <= 2 * rows.count()


def test_ranges_of_ids_are_sent_half_as_often_as_there_are_ranges(spark, tmp_path):
    """A row of a small range goes to every range that follows, packed, not to every pair of tiles with ids beside it."""
    rng = np.random.default_rng(3)
    rows = [(v, s, 1.0 + v) for v in range(40) for s in rng.choice(4000, 60, replace=False).tolist()]
    got = tiles.shared_products(spark.createDataFrame(rows, "v long, s long, x double"), "v", "s", "x", 4096, 300)
    want: dict = {}
    for v in range(40):
        own = sorted(s for w, s, _ in rows if w == v)
        for k, i in enumerate(own):
            for j in own[k:]:
                want[i, j] = want.get((i, j), 0.0) + 1.0 + v
    assert {(r["i"], r["j"]): r["w"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "FlatMapGroups" not in plan and "by#" in plan  # lists of ranges travel, not rows


def test_quick_rounding_equals_round(spark):
    from strandline.plans import catalogue

    rng = np.random.default_rng(5)
    x = [*rng.standard_normal(3000), *(rng.standard_normal(500) * 10.0 ** rng.integers(-9, 20, 500)), *(rng.integers(-(10**7), 10**7, 3000) / 1e6 + 5e-7), *(rng.integers(-999, 999, 300) / 2e6), 0.0, -0.0, -1e-9, 1e-9, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(x)], "k int, x double")
    for digits in (0, 3, 6, 9):
        want = {r["k"]: repr(r["x"]) for r in df.select("k", (F.round("x", digits) + F.lit(0.0)).alias("x")).collect()}
        assert {r["k"]: repr(r["x"]) for r in catalogue.rounded(df, digits).collect()} == want


def test_interaction_matrix_rounds_once_a_pair(spark):
    from strandline.operators import epistasis
    from strandline.plans import catalogue

    rows = [(v, s, 1 + (v + s) % 2) for v in range(4) for s in range(90) if (7 * v + s) % 5 == 0]
    g, s = spark.createDataFrame(rows, "v long, s long, g int"), spark.range(90).withColumnRenamed("id", "s")
    pairs = spark.createDataFrame([(0, 1), (1, 3), (0, 2)], "v1 long, v2 long")
    out = epistasis.interaction_matrix(g, s, pairs, 16, digits=3)
    want = catalogue.rounded(epistasis.interaction_matrix(g, s, pairs, 16), 3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 270
    assert "none#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_graph_features_take_all_variants(spark, tmp_path):
    """10,004 variants of one carrier each: none is left out, in the query or in its SQL."""
    import duckdb

    from strandline.plans import catalogue

    n, d = 2501, str(tmp_path)
    spark.range(40).selectExpr("id AS c_custkey", "0D AS c_acctbal", "'BUILDING' AS c_mktsegment", "0 AS c_nationkey").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "0 AS s_nationkey").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey").coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.range(n).selectExpr("id AS l_orderkey", "id AS l_suppkey", "1D AS l_quantity").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    out = catalogue.QUERIES["graph_export_features"](spark, d)
    assert out.agg(F.sum("n_carried")).first()[0] == 4 * n
    c = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.SQL["graph_export_features"]).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_packed_blocks_of_sparse_carriers_hold_few_codes(spark):
    """Small blocks are made from lists of carriers: the groups that are shuffled do not grow with the blocks."""
    from strandline.operators import genotype

    rng = np.random.default_rng(9)
    rows = [(v, int(s), int(rng.integers(1, 3)) if rng.random() < 0.9 else None) for v in range(30) for s in rng.choice(3_000_000, 200, replace=False)]
    gt = spark.createDataFrame(rows, "v long, packed_index int, g int")
    packed = genotype.pack_carriers(gt, 3_000_001, 64)
    assert packed.agg(F.sum(F.length("gt_packed"))).first()[0] <= 16 * len(rows)
    place = spark.createDataFrame([(s, s) for s in sorted({s for _, s, _ in rows})], "s long, packed_index int")
    assert {tuple(r) for r in genotype.explode_packed(packed, place).collect()} == set(rows)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "packed_from" not in plan.split("MapInArrow", 1)[1].split("Exchange", 1)[1]


def test_pathway_pairs_are_dealt_by_gene(spark):
    """Genes, not variants, are copied for the parts, and a few bytes of genes still make many tasks."""
    from strandline.operators import epistasis

    vg = spark.createDataFrame([(v, v // 5) for v in range(100)], "v long, gene long")
    gp = spark.createDataFrame([(g, p) for g in range(20) for p in ("A", "B") if (g + (p == "B")) % 3], "gene long, pathway string")
    out = epistasis.motif_pairs("same_pathway", vg, gene_pathway=gp)
    of = {g: {p for p in ("A", "B") if (g + (p == "B")) % 3} for g in range(20)}
    want = {(a, b, min(of[a // 5] & of[b // 5])) for a in range(100) for b in range(a + 1, 100) if a // 5 != b // 5 and of[a // 5] & of[b // 5]}
    rows = out.collect()
    assert {(r["v1"], r["v2"], r["entity"]) for r in rows} == want and len(rows) == len(want)
    assert out.rdd.getNumPartitions() >= 64
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(vs2") < plan.index("explode(vs1") < plan.index("Join")  # variants are made above the join
