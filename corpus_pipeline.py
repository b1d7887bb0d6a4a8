"""The corpus pipeline: toxicity, near-duplicates, mixture, packing. Each stage is written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import stage
from strandline.llm.dedup_oph import near_duplicates
from strandline.llm.mix_pfair import mix
from strandline.llm.pack_drr import balanced_targets, pack
from strandline.llm.toxicity_fst import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mixture of stages 3 and 4: a source's weight is its number of documents to this power.
POWER = 0.5
#: Pieces that a worker caches: fewer than pack() by itself has, since workers also hold what other stages left.
CACHE = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.7, all columns as they were.

    Null or empty texts match nothing and stay; null doc_ids and repeated rows are judged by their texts; an empty table
    stays empty; columns other than those of documents are left out, as in every stage."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(docs.select(*COLUMNS), labels, columns=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Rows without doc_id and texts without words stay; of repeated rows with the smallest doc_id all stay; an empty table
    stays empty."""
    gone = near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule: part files and the rows in them follow its positions.

    Null sources are one source; null texts, null doc_ids and repeated rows keep their rows; an empty table stays empty."""
    mixed = mix(docs.select(*COLUMNS), power=POWER, columns=tuple(COLUMNS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences at the mixture's proportions; queues follow the order that the last stage wrote.

    Where docs come from no files there is no written order, and queues follow doc_id. Null texts hold the end id alone; null
    sources share a queue with the weight that the mixture gives them; repeated rows each get pieces; an empty table gives
    no row."""
    written = [F.col("_metadata.file_name"), F.col("_metadata.row_index")] if docs.inputFiles() else [F.lit(""), F.col("doc_id")]
    placed = docs.select("doc_id", "source", "text", written[0].alias("_file"), written[1].alias("_row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "_file", "_row").sortWithinPartitions("_file", "_row")
    return pack(ordered, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048, targets=balanced_targets(docs, POWER), cache=CACHE)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixture", mix_sources), ("packing", pack_windows)]
#: SQL cannot express the first stage; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
