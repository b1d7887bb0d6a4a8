import gzip
import io
import json
import struct
import threading
import urllib.request
import zlib

import numpy as np
import pytest
import zstandard

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """A store of the panel."""
    from strandline.plans import panel as P
    from strandline.surfaces.commands import Store

    path = str(tmp_path_factory.mktemp("store"))
    v = P.variants(spark, DATA)
    tables = {
        "genotype": P.genotypes(spark, DATA), "sample": P.samples(spark, DATA), "variant": v, "gene": P.genes(spark, DATA).drop("pathway"),
        "variant_gene": v.selectExpr("v", "gene", "CASE WHEN v % 4 = 0 THEN 'HIGH' ELSE 'MODERATE' END AS impact"),
        "gene_pathway": P.gene_pathways(spark, DATA), "ppi": P.interactions(spark, DATA),
    }
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return Store(spark, path)


def run(s, name, **options):
    from strandline.surfaces.commands import COMMANDS

    return COMMANDS[name](s, **options)


def test_scan_store_and_what_follows(held, tmp_path):
    done = run(held, "assoc scan", store_results=True)
    key, other = done["run_id"], run(held, "assoc scan", method="logistic", store_results=True)["run_id"]
    assert run(held, "results show", run_id=key).count() == done["results"].count() == 40
    assert run(held, "assoc top-hits", run_id=key, p_threshold=1.0, limit=5).count() == 5
    assert run(held, "plot manhattan", run_id=key).count() == run(held, "plot qq", run_id=key)["points"].count() == 40
    assert run(held, "interpret", run_id=key)["summary"].first()["n_tested"] == 40
    assert run(held, "prs classical", run_id=key, p_threshold=1.0).count() == 150
    assert run(held, "prs pathway", run_id=key, p_threshold=1.0)["effects"].count() > 0
    assert run(held, "prs graph-pruned", run_id=key, p_threshold=1.0)["weights"].count() > 0
    assert run(held, "multivariate pleiotropy", run1=key, run2=other, p_threshold=0.5).count() >= 0
    assert run(held, "multivariate psi", run_ids=f"{key},{other}", p_threshold=0.9).count() > 0
    assert set(run(held, "mr report", exposure_run=key, outcome_run=other, p_threshold=0.9)) == {"ivw", "egger", "weighted_median", "pleiotropy", "by_pathway"}
    run(held, "results export", run_id=key, output=str(tmp_path / "x"))
    assert run(held, "results delete", run_id=key)["deleted"] == 40 and run(held, "results show", run_id=other).count() == 40
    few = run(held, "assoc scan", chr="1", start=0, end=100_000)
    assert 0 < few.count() < 40


def test_commands_of_the_panel(held):
    assert not run(held, "status")["issues"]
    assert run(held, "qc run")["variants"].count() == 40
    assert run(held, "gene-counts").count() == 10
    assert run(held, "assoc mpat").count() == run(held, "assoc mpat", method="undirected").count() == 10
    assert run(held, "finemap", chr="1", start=0, end=200_000).count() > 0
    assert {"edges", "modules", "tests"} == set(run(held, "epistasis scan", permutations=20))
    assert run(held, "flow architecture", af_threshold=0.5, permutations=5)["architecture"].count() == 1
    assert run(held, "heritability spectral", af_threshold=0.3)["h2"] >= 0
    assert run(held, "heritability conductance", af_threshold=0.3, permutations=20).count() == 1
    assert run(held, "spectral correction", af_threshold=0.3).count() == 150
    assert run(held, "popstruct spectral-pcs", af_threshold=0.3, n_components=3).count() == 450
    assert 0 < run(held, "gnn export")["variant"].count() <= 40
    assert run(held, "sql", query="select count(*) n from variant").first()["n"] == 40
    assert run(held, "ensure-indexes")["tables"].count() >= 7


def test_phenotypes_and_trials(held, spark, tmp_path):
    people = [r["s"] for r in held["sample"].select("s").collect()]
    rows = "\n".join(["sample_id,height cm,sick", *(f"{s},{150 + s % 40},{'yes' if s % 3 else 'no'}" for s in people), "nobody,1,no"])
    (tmp_path / "p.csv").write_text(rows)
    got = run(held, "phenotype load", phenotype_file=str(tmp_path / "p.csv"))
    assert (got["matched"], got["unmatched"]) == (150, 1) and got["traits"].count() == 2
    run(held, "phenotype simulated", trait="made", effects="0=0.5,7=0.3")
    assert run(held, "multivariate correlation", trait1="height cm", trait2="made", af_threshold=0.3)["r_g"] is not None
    assert run(held, "multivariate coherence", trait1="height cm", trait2="made", af_threshold=0.3, n_components=5).count() == 5
    n = run(held, "phenotype activate", trait="sick", case_value="yes", control_value="no").first()
    assert n["n_cases"] + n["n_controls"] == 150 and n["n_cases"] == sum(s % 3 > 0 for s in people)
    trial = "\n".join(["line,env,yield", *(f"{g},e{e},{g + e + g * e % 3}" for g in range(15) for e in range(4) if (g, e) != (2, 1))])
    (tmp_path / "t.csv").write_text(trial)
    assert run(held, "met load", csv=str(tmp_path / "t.csv"), genotype_col="line", env_col="env", traits="yield").first()["n"] == 59
    assert run(held, "met gxe", trait="yield").count() == run(held, "met impute", trait="yield", genotype="2", environment="e1").count() == 1
    assert run(held, "met env-similarity", trait="yield").count() == 6 and run(held, "met diagnostics")["balance"].count() == 1
    run(held, "phenotype clear")
    assert held["sample"].where("y IS NOT NULL").isEmpty()
    with pytest.raises(KeyError, match="no table"):
        held["nothing"]


def test_http_routes_and_tools(held):
    from strandline.surfaces import dispatch

    server = dispatch.serve(held, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        req = urllib.request.Request(base + path, data=None if body is None else json.dumps(body).encode(), method="GET" if body is None else "POST")
        try:
            with urllib.request.urlopen(req, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/api/v1/status")[0] == 200
    assert ask("/api/v1/cypher/query", {"query": "select v from variant order by v limit 2"}) == (200, [{"v": 0}, {"v": 1}])
    assert ask("/api/v1/cypher/query", {"query": "drop table variant"})[0] == 400
    assert ask("/api/v1/finemap", {"chr": "1"})[0] == 400 and ask("/api/v1/nowhere", {})[0] == 404
    code, job = ask("/api/v1/flow/architecture", {"af_threshold": 0.5, "permutations": 2})
    assert code == 202
    for _ in range(240):
        state = ask(f"/api/v1/jobs/{job['job_id']}")[1]
        if state["status"] in ("completed", "failed"):
            break
        threading.Event().wait(0.5)
    assert state["status"] == "completed" and "architecture" in state["result"] and len(ask("/api/v1/jobs")[1]) == 1
    big = ask("/api/v1/cypher/query", {"query": "select * from genotype"})[1]
    assert big["of"] == held["genotype"].count() and len(big["rows"]) == 500
    server.shutdown()
    out = io.StringIO()
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "query_graph", "arguments": {"cypher_query": "select 7 x"}}}, {"id": 4, "method": "tools/call", "params": {"name": "compute_prs", "arguments": {}}}]
    dispatch.tools_over(held, [json.dumps(x) for x in lines], out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(said) == 4 and len(said[1]["result"]["tools"]) == 16
    assert json.loads(said[2]["result"]["content"][0]["text"]) == [{"x": 7}] and said[3]["result"]["isError"]


def test_every_route_and_tool_has_a_command():
    from strandline.surfaces import commands, dispatch

    assert {c for _, _, c, _ in dispatch.ROUTES} | {c for cs in dispatch.TOOLS.values() for c in cs} <= set(commands.COMMANDS)


def test_finemap_from_files(spark, tmp_path, capsys):
    from strandline.__main__ import main

    n, rng = 12, np.random.default_rng(3)
    ids = [f"chr1:{100 + k}:A:G" for k in range(n)]
    z = rng.normal(0, 1, n)
    z[4] = 7.0
    (tmp_path / "v.tsv").write_text("\n".join(["variant_id\tchr\tpos\tref\talt\taf", *(f"{v}\t1\t{100 + k}\tA\tG\t0.2" for k, v in enumerate(ids))]))
    (tmp_path / "z.tsv").write_text("\n".join(["variant_id\tz", *(f"{v}\t{x}" for v, x in zip(ids, z))]))
    np.savez(tmp_path / "ld.npz", R_sq=np.exp(-np.abs(np.subtract.outer(np.arange(n), np.arange(n)))))
    for method in ("gafm", "hbp", "gafm-mx", "hbp-mx", "ens"):
        main(["--store", str(tmp_path), "finemap-sumstats", "--variants-tsv", str(tmp_path / "v.tsv"), "--z-tsv", str(tmp_path / "z.tsv"), "--ld-npz", str(tmp_path / "ld.npz"), "--n-samples", "500", "--method", method, "--out-tsv", str(tmp_path / f"out-{method}")])
        got = {r["variant_id"]: r for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / f"out-{method}")).collect()}
        assert len(got) == n and got[ids[4]]["rank"] == "1" and got[ids[4]]["in_credible_set"] == "true"


def bgen_bytes(variants, samples, packing, bits, phased):
    """variants: (chr, pos, alleles, probabilities (n, 2), missing)"""
    pack = {0: lambda x: x, 1: zlib.compress, 2: lambda x: zstandard.ZstdCompressor().compress(x)}[packing]
    word = lambda x, f="<H": struct.pack(f, len(x)) + x.encode()
    ids = b"".join(word(x) for x in samples)
    head = struct.pack("<3I", 20, len(variants), len(samples)) + b"bgen" + struct.pack("<I", packing | 2 << 2 | 1 << 31)
    block = struct.pack("<2I", 8 + len(ids), len(samples)) + ids
    out = [struct.pack("<I", len(head) + len(block)), head, block]
    for chr_, pos, alleles, probs, missing in variants:
        cells = np.rint(np.asarray(probs).ravel() * ((1 << bits) - 1)).astype(np.uint64)
        packed = np.packbits(((cells[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        data = struct.pack("<IHBB", len(samples), len(alleles), 2, 2) + bytes(2 | (128 if m else 0) for m in missing) + bytes([phased, bits]) + packed
        body = pack(data)
        body = (struct.pack("<I", len(data)) if packing else b"") + body
        out.append(word(f"id{pos}") + word(f"rs{pos}") + word(chr_) + struct.pack("<IH", pos, len(alleles)) + b"".join(word(a, "<I") for a in alleles) + struct.pack("<I", len(body)) + body)
    return b"".join(out)


@pytest.mark.parametrize(("packing", "bits", "phased"), [(0, 8, 0), (1, 16, 0), (2, 8, 1), (1, 5, 0)])
def test_bgen_round_trip(spark, tmp_path, packing, bits, phased):
    from strandline.sources.readers import bgen, dosage_rows

    rng = np.random.default_rng(bits)
    samples, variants, want = [f"s{k}" for k in range(37)], [], {}
    for pos in (100, 200, 300):
        p = rng.dirichlet([1, 1, 1], 37)[:, :2] if not phased else rng.integers(0, 2, (37, 2)).astype(float)
        p = np.rint(p * ((1 << bits) - 1)) / ((1 << bits) - 1)
        gone = rng.random(37) < 0.1
        variants.append(("chr22" if pos > 100 else "22", pos, ["A", "G"], p, gone))
        d = 2 - p.sum(1) if phased else p[:, 1] + 2 * (1 - p.sum(1))
        want[pos] = [None if m else x for m, x in zip(gone, d)]
    variants.append(("22", 400, ["A", "C", "T"], np.zeros((37, 2)), np.zeros(37, bool)))
    (tmp_path / "x.bgen").write_bytes(bgen_bytes(variants, samples, packing, bits, phased))
    got = {r["pos"]: r for r in bgen(spark, str(tmp_path / "x.bgen")).collect()}
    assert set(got) == {100, 200, 300} and got[200]["variant_id"] == "chr22:200:A:G" and got[100]["rsid"] == "rs100"
    for pos, r in got.items():
        assert r["sample"] == samples and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-5) for a, b in zip(r["dosage"], want[pos]))
    few = bgen(spark, str(tmp_path / "x.bgen"), "22", 150, 250)
    assert [r["pos"] for r in few.collect()] == [200]
    rows = dosage_rows(few, hard_calls=True).collect()
    assert all(r["g"] in (None, 1, 2) for r in rows) and len(rows) <= 37
    (tmp_path / "bad.bgen").write_bytes(b"\0" * 64)
    with pytest.raises(Exception, match="layout 2"):
        bgen(spark, str(tmp_path / "bad.bgen")).collect()


def test_bgen_splits_and_index(spark, tmp_path):
    """Splits of every size give the same rows; with an index only the region's bytes are read."""
    import sqlite3

    from strandline.sources.bgen_source import BgenVariants, bgen_head, passed_over
    from strandline.sources.readers import bgen

    rng = np.random.default_rng(9)
    samples = [f"s{k}" for k in range(11)]
    variants = [("22" if k % 3 else "chr2", 10 * k, ["A", "G" * (1 + 700 * (k == 5))], rng.dirichlet([1, 1, 1], 11)[:, :2], np.zeros(11, bool)) for k in range(60)]
    raw = bgen_bytes(variants, samples, 1, 8, 0)
    path = tmp_path / "x.bgen"
    path.write_bytes(raw)
    spark.dataSource.register(BgenVariants)
    read = lambda **o: spark.read.format("bgen_variants").options(**o).load(str(path))
    key = lambda df: sorted((r["chr"], r["pos"], tuple(r["dosage"])) for r in df.collect())
    whole = key(read())
    assert len(whole) == 60 and read().rdd.getNumPartitions() == 1
    for split in (1, 500):
        assert key(read(split_bytes=split)) == whole and read(split_bytes=split).rdd.getNumPartitions() > 8
    wanted = [x for x in whole if x[0] == "22" and 100 <= x[1] <= 300]
    assert key(bgen(spark, str(path), "chr22", 100, 300)) == wanted and len(wanted) == 14
    first, count, *_ = bgen_head(raw)
    with path.open("rb") as f:
        places = list(passed_over(f, first, count))
    db = sqlite3.connect(tmp_path / "x.bgen.bgi")
    db.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
    db.executemany("INSERT INTO Variant VALUES (?, ?, ?, 2, ?, ?, ?, ?)", [(c, p, f"rs{p}", a[0], a[1], *place) for (c, p, a, *_), place in zip(variants, places)])
    db.commit()
    db.close()
    broken = bytearray(raw)
    for (c, p, *_), (at, size) in zip(variants, places):
        if c != "22" or not 100 <= p <= 300:
            broken[at : at + size] = bytes(size)
    path.write_bytes(broken)
    assert key(bgen(spark, str(path), "22", 100, 300)) == wanted
    assert bgen(spark, str(path), "7").count() == 0


def test_block_gzip(spark, tmp_path):
    from strandline.sources.readers import panukb, phenotype_manifest

    lines = ["chr\tpos\tref\talt\taf_EUR\tbeta_EUR\tse_EUR\tneglog10_pval_EUR\tlow_confidence_EUR"] + [f"1\t{k}\tA\tG\t0.1\t{k / 10}\t0.5\t{k / 100}\tfalse" for k in range(1, 2001)]
    text = ("\n".join(lines) + "\n").encode()
    parts = [text[k : k + 7000] for k in range(0, len(text), 7000)]
    (tmp_path / "x.tsv.bgz").write_bytes(b"".join(gzip.compress(p) for p in parts) + gzip.compress(b""))
    got = panukb(spark, str(tmp_path / "x.tsv.bgz")).collect()
    assert len(got) == 2000 and {r["pos"] for r in got} == set(range(1, 2001))
    assert got[0]["beta"] == pytest.approx(got[0]["pos"] / 10)
    (tmp_path / "m.tsv.bgz").write_bytes(gzip.compress(b"trait_type\tphenocode\ncontinuous\t50\nicd10\tE11\n"))
    assert [r["phenocode"] for r in phenotype_manifest(spark, str(tmp_path / "m.tsv.bgz"), "icd10").collect()] == ["E11"]


def test_logistic_with_covariates(spark):
    from strandline.operators.assoc import fit_logistic, logistic_scan_adjusted

    rng = np.random.default_rng(5)
    n = 400
    x1, x2 = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    g = rng.binomial(2, 0.2, (3, n))
    g[2] = 0
    g[2, :3] = 1  # a rare variant that separates the classes
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.6 * g[0] + 0.8 * x1)))).astype(float)
    y[:3] = 1
    genos = spark.createDataFrame([(int(v), int(s), int(g[v, s])) for v in range(3) for s in range(n) if g[v, s]], "v long, s long, g int")
    people = spark.createDataFrame([(s, bool(y[s]), float(x1[s]), float(x2[s])) for s in range(n)] + [(n, None, 0.0, 0.0), (n + 1, True, None, 0.0)], "s long, is_case boolean, a double, b double")
    plain = {r["v"]: r for r in logistic_scan_adjusted(genos, people, ["a", "b"], firth=False).collect()}
    firth = {r["v"]: r for r in logistic_scan_adjusted(genos, people, ["a", "b"]).collect()}
    for v in (0, 1):
        b, cov, _, good = fit_logistic(np.column_stack([np.ones(n), g[v], x1, x2]), y)
        p = 1 / (1 + np.exp(-(np.column_stack([np.ones(n), g[v], x1, x2]) @ b)))
        assert good and np.abs(np.column_stack([np.ones(n), g[v], x1, x2]).T @ (y - p)).max() < 1e-6  # the score is zero
        assert plain[v]["beta"] == pytest.approx(b[1], rel=1e-6) and plain[v]["se"] == pytest.approx(cov[1, 1] ** 0.5, rel=1e-6)
        assert firth[v]["beta"] == pytest.approx(b[1], abs=0.1) and plain[v]["n"] == n
    assert firth[0]["p_value"] < 0.01 < firth[1]["p_value"] + 0.01
    assert 0 < firth[2]["beta"] < 6 and 0.01 < firth[2]["p_value"] < 1  # finite where the plain fit runs away
    with pytest.raises(ValueError, match="more than"):
        logistic_scan_adjusted(genos, people, ["a"], max_bytes=100)
