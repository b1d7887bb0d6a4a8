"""The jobs as registered queries: each runs its job twice into one new folder and returns what stands there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs.association_release import association_release
from jobs.common import shipped_config
from jobs.note_phenotypes import ALL, note_phenotypes
from strandline.operators.lineage import shared_dir
from strandline.plans import panel
from strandline.plans.catalogue import COUNTS, TAIL, rounded


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_note_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as notes; the second run finds no new file."""
    at, config = new_folder(spark, "note_phenotypes"), shipped_config("note_phenotypes")
    notes = f"{sf_dir}/document[s].parquet"  # a pattern: the table is one file or a folder of them
    note_phenotypes(spark, notes, at, f"{at}/checkpoint", config)
    return note_phenotypes(spark, notes, at, f"{at}/checkpoint", config)


def job2_association_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traits of the configuration; the second run replaces every partition."""
    at, config = new_folder(spark, "association_release"), shipped_config("association_release")
    association_release(spark, sf_dir, at, config)
    return rounded(association_release(spark, sf_dir, at, config))


def _job1() -> str:
    c = shipped_config("note_phenotypes")
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    terms = ", ".join(f"('{p}', '{t}')" for p, words in c["phenotypes"].items() for t in words)
    return f"""
WITH n AS (SELECT row_number() OVER () AS id, doc_id // 2 AS s, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
lexicon(phenotype, term) AS (VALUES {terms}),
placed AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM n),
hits AS (SELECT id, s, len(w) AS n_words, w[i] AS term, len(list_filter(w[greatest(i - {c["negation_window"]}, 1):i - 1], lambda x: x IN ({quoted(c["negators"])}))) > 0 AS negated FROM placed),
facts AS (SELECT id, s, phenotype, any_value(n_words) AS n_words, count(*) AS n_mentions, count(*) FILTER (negated) AS n_negated FROM hits JOIN lexicon USING (term) GROUP BY id, s, phenotype
 UNION ALL SELECT id, s, '{ALL}', len(w), 0, 0 FROM n)
SELECT s, count(*) AS n_notes, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_mentions) AS BIGINT) AS n_mentions, CAST(sum(n_negated) AS BIGINT) AS n_negated,
 CASE WHEN phenotype <> '{ALL}' THEN sum(n_mentions) - sum(n_negated) >= {c["min_mentions"]} END AS is_case, phenotype FROM facts GROUP BY s, phenotype
"""


def _job2() -> str:
    c = shipped_config("association_release")
    value = lambda t: t["value"].replace("max(c_mktsegment", "bool_or(c_mktsegment")
    wide = " UNION ALL ".join(f"SELECT '{t['name']}' AS trait, {t['sample']} AS s, CAST({value(t)} AS DOUBLE) AS y FROM {t['table']} WHERE {t['sample']} IS NOT NULL GROUP BY 2" for t in c["traits"] if t["kind"] == "quantitative")
    binary = next(t["name"] for t in c["traits"] if t["kind"] == "binary")
    return f"""
WITH RECURSIVE {panel.PANEL},{COUNTS.split("WITH ", 1)[1]},
tr AS ({wide}),
tot AS (SELECT trait, count(*) AS n, avg(y) AS my, var_pop(y) AS vy FROM tr WHERE y IS NOT NULL GROUP BY trait),
sums AS (SELECT trait, v, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(g * g) AS DOUBLE) AS sgg, sum(g * y) AS sgy FROM genotype JOIN tr USING (s) WHERE y IS NOT NULL GROUP BY trait, v),
lin AS (SELECT trait, v, n, sgg - sg * sg / n AS vg, sgy - sg * my AS cgy, vy * n AS vyn FROM sums JOIN tot USING (trait)),
fit AS (SELECT trait, v, n, CASE WHEN vg > 0 THEN cgy / vg ELSE 0 END AS beta, CASE WHEN vg > 0 THEN cgy * cgy / (vg * vyn) ELSE 0 END AS r2 FROM lin),
x AS (SELECT trait, v, beta, r2 * (n - 2) / (1 - r2) AS chi2 FROM fit UNION ALL
 SELECT '{binary}', v, CASE WHEN a * b * c * d > 0 THEN ln(a * d / (b * c)) ELSE 0 END, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN (a + b + c + d) * power(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) ELSE 0 END FROM allelic),
p AS (SELECT *, {TAIL.format(x="chi2")} AS p_value FROM x),
level AS (SELECT trait, count(*) AS n_tests, quantile_cont(chi2, 0.5) / 0.4549 AS lambda_gc FROM p GROUP BY trait)
SELECT v, variant_id, pos, round(beta, 6) AS beta, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, n_tests, round(lambda_gc, 6) AS lambda_gc, p_value * n_tests <= {c["p_hit"]} AS is_hit, trait, variant.chr FROM p JOIN level USING (trait) JOIN variant USING (v)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_note_phenotypes": job1_note_phenotypes, "job2_association_release": job2_association_release}
SQL: dict[str, str] = {"job1_note_phenotypes": _job1(), "job2_association_release": _job2()}
