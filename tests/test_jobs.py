import logging
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs.common import shipped_config
from tests.test_catalogue import DATA, plain

NOTES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["job1_note_phenotypes", "job2_association_release"])
def test_job_equals_sql(spark, name):
    from jobs.registered import QUERIES, SQL

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[k]) for k in columns) for r in got.collect()), key=repr)
    assert a and a == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def config(**more):
    return dict(sample="doc_id div 2", negators=["no", "not"], negation_window=2, min_mentions=2, files_per_batch=1, phenotypes={"blast": ["spot", "lesion"], "drought": ["dry"]}) | more


def notes(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], NOTES).coalesce(1).write.mode("append").parquet(path)


def cases(df):
    return {(r["s"], r["phenotype"]): (r["n_notes"], r["n_words"], r["n_mentions"], r["n_negated"], r["is_case"]) for r in df.collect()}


def test_notes_arrive_in_two_runs(spark, tmp_path, caplog):
    """The second run reads the new file alone; both together are as one run over all files."""
    from jobs.note_phenotypes import FACTS, note_phenotypes

    caplog.set_level(logging.INFO, "strandline.jobs")
    first = [(0, "Spot, and a LESION; no spot. Dry-dry"), (1, "not so dry"), (2, None), (None, "spot spot")]
    second = [(3, "lesion no no lesion"), (4, ""), (0, "spot")]
    at, out = str(tmp_path / "notes"), str(tmp_path / "out")
    notes(spark, at, first)
    one = cases(note_phenotypes(spark, at, out, f"{out}/checkpoint", config()))
    assert one == {(0, "all_notes"): (2, 11, 0, 0, None), (0, "blast"): (1, 8, 3, 1, True), (0, "drought"): (2, 11, 3, 2, False), (1, "all_notes"): (1, 0, 0, 0, None)}
    files = sorted(os.listdir(f"{out}/facts/phenotype=blast"))
    notes(spark, at, second)
    two = cases(note_phenotypes(spark, at, out, f"{out}/checkpoint", config()))
    assert two[(0, "blast")] == (2, 9, 4, 1, True) and two[(1, "blast")] == (1, 4, 2, 1, False) and two[(2, "all_notes")] == (1, 0, 0, 0, None)
    assert set(files) <= set(os.listdir(f"{out}/facts/phenotype=blast"))
    assert [m for m in caplog.messages if m.startswith("read")] == [f"read 4 new notes of {at} in 1 batches", f"read 3 new notes of {at} in 1 batches"]
    assert cases(note_phenotypes(spark, at, out, f"{out}/checkpoint", config())) == two
    other = str(tmp_path / "other")
    assert cases(note_phenotypes(spark, at, other, f"{other}/checkpoint", config(files_per_batch=64))) == two
    assert spark.read.schema(FACTS).parquet(f"{out}/facts").count() == spark.read.schema(FACTS).parquet(f"{other}/facts").count() == 11
    with pytest.raises(ValueError, match="another configuration"):
        note_phenotypes(spark, at, out, f"{out}/checkpoint", config(min_mentions=1))


def test_no_notes_yet(spark, tmp_path):
    from jobs.note_phenotypes import note_phenotypes

    os.makedirs(tmp_path / "notes")
    out = str(tmp_path / "out")
    assert note_phenotypes(spark, str(tmp_path / "notes"), out, f"{out}/checkpoint", config()).count() == 0
    notes(spark, str(tmp_path / "notes"), [])
    assert note_phenotypes(spark, str(tmp_path / "notes"), out, f"{out}/checkpoint", config()).count() == 0
    notes(spark, str(tmp_path / "notes"), [(7, "dry dry")])
    assert cases(note_phenotypes(spark, str(tmp_path / "notes"), out, f"{out}/checkpoint", config())) == {(3, "all_notes"): (1, 2, 0, 0, None), (3, "drought"): (1, 2, 2, 0, True)}


def test_release_replaces_its_own_partitions(spark, tmp_path):
    from jobs.association_release import GENES, association_release
    from jobs.note_phenotypes import note_phenotypes

    out, shipped = str(tmp_path / "out"), shipped_config("association_release")
    noted = str(tmp_path / "noted")
    note_phenotypes(spark, f"{DATA}/document[s].parquet", noted, f"{noted}/checkpoint", shipped_config("note_phenotypes"))
    key = lambda df: sorted(map(str, df.collect()))
    all_ = key(association_release(spark, DATA, out, shipped | {"note_phenotypes": ["drought"]}, f"{noted}/cases"))
    traits = {r["trait"] for r in spark.read.schema(GENES).parquet(f"{out}/genes").collect()}
    assert traits == {"balance", "order_total", "segment", "notes_drought"}
    before = {(d, f) for d, _, fs in os.walk(f"{out}/results/trait=balance") for f in fs}
    again = key(association_release(spark, DATA, out, shipped | {"traits": shipped["traits"][2:]}))
    assert all_ == again and before == {(d, f) for d, _, fs in os.walk(f"{out}/results/trait=balance") for f in fs}
    genes = {r["gene"]: r for r in spark.read.schema(GENES).parquet(f"{out}/genes").where("trait = 'balance'").collect()}
    best = {}
    for r in association_release(spark, DATA, out, shipped | {"traits": []}).where("trait = 'balance'").collect():
        for g in range(spark.read.parquet(f"{DATA}/supplier.parquet").count()):
            start = g // 5 * 100000 + 1
            if g % 5 + 1 == r["chr"] and start - 2000 <= r["pos"] <= start + 5000:
                best[g] = min(best.get(g, 1), r["p_value"])
    assert {g: r["min_p"] for g, r in genes.items()} == best


def test_command_lines(tmp_path):
    """Each job as a process of its own, twice, with a configuration in a file."""
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parent.parent
    c = tmp_path / "c.toml"
    c.write_text((here / "jobs" / "note_phenotypes.toml").read_text().partition("[phenotypes]")[0] + '[phenotypes]\ner = ["er"]\n')
    cmd = [sys.executable, "-m", "jobs.note_phenotypes", "--notes", f"{DATA}/document[s].parquet", "--out", str(tmp_path / "o"), "--config", str(c)]
    said = [subprocess.run(cmd, cwd=here, check=True, capture_output=True, text=True).stderr for _ in range(2)]
    assert "read 200 new notes" in said[0] and "read 0 new notes" in said[1] and "cases/phenotype=er" in said[1]


def test_release_makes_and_joins_the_genotypes_once(spark, tmp_path, monkeypatch):
    from jobs import association_release as job
    from strandline.operators import genotype

    seen, real = spark.sparkContext.accumulator(0), job.panel.genotypes

    def note(x):
        seen.add(1)
        return x

    n = real(spark, DATA).count()
    monkeypatch.setattr(job.panel, "genotypes", lambda s, d: real(s, d).select("v", "s", F.udf(note, "int")("g").alias("g")))
    config = shipped_config("association_release")
    assert job.association_release(spark, DATA, str(tmp_path / "out"), config | {"traits": config["traits"][::2]}).count()
    assert seen.value == n
    g = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, None), (2, 4, 1)], "v long, s long, g int")
    s = spark.createDataFrame([(1, 0.5, True), (2, 1.5, False), (3, 2.5, True), (4, None, None), (5, 1.0, False)], "s long, y double, is_case boolean")
    met = g.join(s, "s")
    assert genotype.moments(met, s.select("s", "y")).collect() == genotype.moments(g, s.select("s", "y")).collect()
    assert genotype.count_tables(met, s.select("s", "is_case")).collect() == genotype.count_tables(g, s.select("s", "is_case")).collect()
