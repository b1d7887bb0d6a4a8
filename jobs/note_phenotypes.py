"""Phenotypes from field notes, as a stream: python -m jobs.note_phenotypes --notes PATH --out PATH [--checkpoint PATH] [--config PATH]

A cohort's notes (documents: doc_id, text, lang, source) name traits in free text before anyone keys them in; an association
scan needs cases and controls. The configuration lists the terms of each phenotype, words that negate a term within a few
words before it, and the number of plain mentions that makes a case. Each run takes the files that are new since the last:

  out/facts    one row for each note and phenotype that it mentions, and one for each note (phenotype `all_notes`): written by
               a file stream, exactly once by its checkpoint
  out/cases    one row for each sample and phenotype, from all facts: partitions are replaced whole, so that a run which is
               repeated after a failure gives the same table
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import hold_config, log, read_config, replace_partitions, shipped_config, table_or_empty

NOTES = "doc_id long, text string, lang string, source string"
FACTS = "s long, doc_id long, n_words long, n_mentions long, n_negated long, phenotype string"
CASES = "s long, n_notes long, n_words long, n_mentions long, n_negated long, is_case boolean, phenotype string"
ALL = "all_notes"
#: A word is a run of anything but ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def note_facts(notes: DataFrame, config: dict) -> DataFrame:
    """FACTS of notes, row by row. Notes without a sample are left out; null and empty texts have no words."""
    terms = sorted({t for words in config["phenotypes"].values() for t in words})
    reach = int(config["negation_window"])
    x = notes.select(F.expr(config["sample"]).cast("long").alias("s"), "doc_id", words_of(F.col("text")).alias("w")).where("s IS NOT NULL")
    word = lambda i: F.get("w", i - 1)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.coalesce(word(i).isin(terms), F.lit(False)))
    x = x.withColumn("at", at)
    negated = lambda i: F.exists(F.slice("w", F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach))), lambda v: v.isin(config["negators"]))
    x = x.withColumn("hits", F.transform("at", lambda i: F.struct(word(i).alias("term"), negated(i).alias("negated"))))
    n = F.size("w").cast("long").alias("n_words")
    size = lambda a: F.size(a).cast("long")
    each = [F.struct(n, F.lit(0).cast("long").alias("n_mentions"), F.lit(0).cast("long").alias("n_negated"), F.lit(ALL).alias("phenotype"))]
    of = lambda own: F.filter("hits", lambda h: h["term"].isin(own))
    for name, own in sorted(config["phenotypes"].items()):
        mine = of(own)
        each.append(F.struct(n, size(mine).alias("n_mentions"), size(F.filter(mine, lambda h: h["negated"])).alias("n_negated"), F.lit(name).alias("phenotype")))
    return x.select("s", "doc_id", F.inline(F.array(*each))).where(f"n_mentions > 0 OR phenotype = '{ALL}'")


def cases_of(facts: DataFrame, min_mentions: int) -> DataFrame:
    """CASES: mentions that are not negated, summed over a sample's notes, against the least number."""
    sums = facts.groupBy("s", "phenotype").agg(F.count("*").alias("n_notes"), *[F.sum(c).alias(c) for c in ("n_words", "n_mentions", "n_negated")])
    case = F.when(F.col("phenotype") != ALL, F.col("n_mentions") - F.col("n_negated") >= min_mentions)
    return sums.select("s", "n_notes", "n_words", "n_mentions", "n_negated", case.alias("is_case"), "phenotype")


def note_phenotypes(spark: SparkSession, notes: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes the new files of `notes`, a folder or a pattern, into out/facts, rebuilds out/cases, and returns it as written."""
    if ALL in config["phenotypes"]:
        raise ValueError(f"{ALL} is the name of the rows that count a sample's notes")
    hold_config(spark, f"{out}/config", {k: v for k, v in config.items() if k != "files_per_batch"})
    stream = spark.readStream.schema(NOTES).option("maxFilesPerTrigger", config.get("files_per_batch", 64)).parquet(notes)
    run = note_facts(stream, config).writeStream.format("parquet").partitionBy("phenotype").option("path", f"{out}/facts").option("checkpointLocation", f"{checkpoint}/facts").trigger(availableNow=True).start()
    run.awaitTermination()
    new = [p for p in run.recentProgress if p["numInputRows"]]
    log.info("read %d new notes of %s in %d batches", sum(p["numInputRows"] for p in new), notes, len(new))
    facts = table_or_empty(spark, f"{out}/facts", FACTS)
    replace_partitions(cases_of(facts, int(config["min_mentions"])), f"{out}/cases", "phenotype")
    cases = spark.read.schema(CASES).parquet(f"{out}/cases")
    for r in cases.groupBy("phenotype").agg(F.count("*").alias("n"), F.count_if("is_case").alias("k")).orderBy("phenotype").toLocalIterator():
        log.info("wrote %s/cases/phenotype=%s: %d samples, %d cases", out, r["phenotype"], r["n"], r["k"])
    return cases


def main(argv: list[str] | None = None) -> None:
    from strandline.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--notes", required=True, help="folder of Parquet files of notes, or a pattern")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", help="default: checkpoint under --out")
    p.add_argument("--config", help="TOML; default: the one beside this file")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("note_phenotypes")
    try:
        config = read_config(spark, a.config) if a.config else shipped_config("note_phenotypes")
        note_phenotypes(spark, a.notes, a.out, a.checkpoint or f"{a.out}/checkpoint", config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
