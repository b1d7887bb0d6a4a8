import math

import duckdb
import numpy as np
import pytest

from strandline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x) + 0.0, 5)
    return x.item() if isinstance(x, np.generic) else x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_no_nested_loops_or_products(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    """A copy without strandline/llm, tests/llm and corpus_pipeline.py has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parent.parent
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json", "*.txt"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'assoc_top_hits' in q and not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); import strandline.surfaces.dispatch, strandline.__main__"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "r")


def test_relationship_matrix_of_all_samples(spark):
    from strandline.plans import panel

    ids = sorted(r["s"] for r in panel.samples(spark, DATA).collect())
    at, rows = {s: k for k, s in enumerate(ids)}, panel.genotypes(spark, DATA).collect()
    vs = {v: k for k, v in enumerate(sorted({r["v"] for r in rows}))}
    g = np.zeros((len(vs), len(ids)))
    for r in rows:
        g[vs[r["v"]], at[r["s"]]] = r["g"]
    af = g.mean(1) / 2
    z = ((g.T - 2 * af) / np.sqrt(np.maximum(2 * af * (1 - af), 1e-300))).T[(af > 0.01) & (af < 0.99)]
    want = z.T @ z / len(z)
    got = catalogue.QUERIES["relationship_matrix"](spark, DATA).collect()
    assert len(got) == len(ids) * (len(ids) + 1) // 2
    assert all(abs(r["w"] - want[at[r["i"]], at[r["j"]]]) < 1e-5 for r in got)


def test_components_and_walks_of_all_nodes(spark):
    from strandline.plans import panel

    genes = {r["gene"] for r in panel.genes(spark, DATA).collect()}
    got = catalogue.QUERIES["graph_components"](spark, DATA).collect()
    edges = [(r["a"], r["b"]) for r in panel.interactions(spark, DATA).collect()]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["component"] for r in got} == root and len(genes) > 1


def test_every_variant_seeds_a_walk(spark, monkeypatch):
    from strandline.operators import rwr

    seen, walk = [], rwr.walk
    monkeypatch.setattr(rwr, "walk", lambda *a, **k: seen.append((a, k)) or walk(*a, **k))
    catalogue.QUERIES["random_walk_pairs"](spark, DATA).collect()
    (a, k), = seen
    assert a[1].count() == spark.read.parquet(f"{DATA}/supplier.parquet").count() * 4 and not k


def test_corrected_scan_chooses_its_correction(spark, monkeypatch):
    from strandline.operators import structure

    tried, lam = [], structure.lambda_gc
    monkeypatch.setattr(structure, "lambda_gc", lambda df: tried.append(df) or lam(df))
    got = catalogue.QUERIES["corrected_scan"](spark, DATA)
    assert tried and got.count() > 0
    best = min(abs(lam(df).first()["lambda_gc"] - 1) for df in tried)
    assert len(tried) == 3 or best <= 0.05
    assert abs(lam(got).first()["lambda_gc"] - 1) == pytest.approx(best)


@pytest.mark.parametrize(("name", "draws"), [("flow_tests", 100), ("conductance_heritability", 200), ("module_permutations", 1000)])
def test_nulls_have_the_default_draws(spark, monkeypatch, name, draws):
    import inspect

    module, f = {"flow_tests": (catalogue.flow, "test_flows"), "conductance_heritability": (catalogue.structure, name), "module_permutations": (catalogue.epistasis, "module_permutation")}[name]
    used, real = [], getattr(module, f)

    def spy(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        used.append(bound.arguments["draws"])
        return real(*a, **k)

    monkeypatch.setattr(module, f, spy)
    p = [r["p_value"] for r in catalogue.QUERIES[name](spark, DATA).collect()]
    assert used == [draws] and all(abs(x * (draws + 1) - round(x * (draws + 1))) < 1e-6 for x in p)
