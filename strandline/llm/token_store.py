"""Token ids in a binary container: one zstandard frame for each document, a shared dictionary, an offset index.

Format (a Parquet folder, so that any store that Spark reaches holds it and its commit protocol survives lost executors):
`shards`: one row holds up to SHARD_BYTES of frames: part, shard, low and high (of its doc_ids), first_start (ids before it in its part), dict_hash,
doc_ids, id_counts, offsets (n + 1 byte offsets into blob), blob. `parts`: part, base (ids of all documents before the
part). `dictionary`: one row, dict_hash and the trained dictionary (empty where there was too little to train on).
Frames hold little-endian unsigned 16-bit ids where the vocabulary has at most 65536 ids, else 32-bit ids (`width`)."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir, sliced
from strandline.llm.fast_ids import encoder

SHARD_BYTES = 1 << 20
SHARD_SCHEMA = "part int, shard int, low long, high long, first_start long, dict_hash string, width int, doc_ids array<long>, id_counts array<long>, offsets array<long>, blob binary"
READ_SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long"
#: The dictionary is trained on so many documents in the mean, of each at most so many bytes of ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8192, 65536


def _serial(ids: bytes, end_id: int, width: int) -> bytes:
    ids += int(end_id).to_bytes(4, "little")
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """From documents chosen by their ids' hashes: the same ones however the rows are partitioned, and no top-n to gather."""
    share = (SAMPLE_DOCS << 30) // max(1, docs.count())
    # Of a long text a stretch of SAMPLE_BYTES characters whose place follows from its hash, so that no part of texts is left out.
    room = F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("text", F.lit(3)), room.cast("long")).cast("int") + 1
    keyed = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select(F.substring(F.col("text"), begin, F.lit(SAMPLE_BYTES)).alias("text"), F.xxhash64("text").alias("h"))
    picked = [r["text"] for r in keyed.orderBy("h").limit(8 * SAMPLE_DOCS).collect()]
    enc = encoder(tokenizer)
    samples = [_serial(enc.encode(x or ""), end_id, width)[:SAMPLE_BYTES] for x in picked]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 20_000:
        return b""
    return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 10)), samples, level=3).as_bytes()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, level: int = 1) -> None:
    """Writes docs (doc_id, text) to path in ascending order of doc_id; null ids come first, ties by text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = 2 if encoder(tokenizer).tok.get_vocab_size() <= 65536 and end_id < 65536 else 4
    trained = train_dictionary(docs, tokenizer, end_id, width)
    name = hashlib.sha256(trained).hexdigest()

    def shards(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        held = zstandard.ZstdCompressionDict(trained) if trained else None
        zstd = zstandard.ZstdCompressor(level=level, dict_data=held)
        number = start = first = size = 0
        ids, counts, offsets, blob = [], [], [0], []

        def full():
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([dict(part=part, shard=number, low=min(known, default=None), high=max(known, default=None), first_start=first, dict_hash=name, width=width, doc_ids=ids, id_counts=counts, offsets=offsets, blob=b"".join(blob))], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("first_start", pa.int64()), ("dict_hash", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("id_counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("blob", pa.binary())])
        for b in sliced(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), enc.encode_column(b["text"]), strict=True):
                raw = _serial(text, end_id, width)
                frame = zstd.compress(raw)
                ids.append(doc_id)
                counts.append(len(raw) // width)
                start += counts[-1]
                size += len(frame)
                offsets.append(size)
                blob.append(frame)
                if size >= SHARD_BYTES:
                    yield full()
                    number, first, size = number + 1, start, 0
                    ids, counts, offsets, blob = [], [], [0], []
        if ids:
            yield full()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(name, bytearray(trained))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    counts = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select("part", F.aggregate("id_counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    totals.select("part", base.alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32 of every document. Raises on a wrong dictionary."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    trained, name = bytes(row["dictionary"]), row["dict_hash"]

    def docs(batches):
        held = zstandard.ZstdCompressionDict(trained) if trained else None
        for b in sliced(batches, 8):
            for r in b.to_pylist():
                if r["dict_hash"] != name:
                    raise ValueError("shard and dictionary do not belong together")
                unzip = zstandard.ZstdDecompressor(dict_data=held)
                starts = r["first_start"] + np.concatenate([[0], np.cumsum(r["id_counts"])])
                crcs = [zlib.crc32(np.frombuffer(unzip.decompress(r["blob"][x:y]), "<u%d" % r["width"]).astype("<u4").tobytes()) for x, y in zip(r["offsets"], r["offsets"][1:], strict=False)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array(starts[:n], pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["id_counts"], pa.int64()), pa.array(crcs, pa.int64())], ["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])

    found = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").mapInArrow(docs, READ_SCHEMA)
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    return found.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document: its shard's index row and one frame are read.

    Shards are in ascending order of doc_id with least and greatest id as columns of their own, so Parquet's statistics pass
    over the row groups and files of other shards."""
    trained = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    near = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    shard = near.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("width", F.array_position("doc_ids", F.lit(doc_id).cast("long")).alias("k"), "offsets", "blob")
    cut = shard.select("width", F.expr("substring(blob, CAST(offsets[k - 1] + 1 AS INT), CAST(offsets[k] - offsets[k - 1] AS INT))").alias("frame")).first()
    if cut is None:
        raise KeyError(doc_id)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return np.frombuffer(unzip.decompress(bytes(cut["frame"])), "<u%d" % cut["width"]).tolist()


def tokens_query(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a fresh container in the shared folder and returns what is read back from it.

    Null or empty texts hold the end id alone; an empty table gives no row; repeated ids each keep their place (ties by
    the text's hash); columns other than doc_id and text are left out."""
    path = f"{shared_dir(docs.sparkSession)}/strandline/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
