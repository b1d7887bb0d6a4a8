"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has CUT_BITS leading zeros (between SMALLEST and LARGEST
bytes a chunk). Chunks are known by digest. Those that occur once are stored beside their payload's recipe; those that
occur more often are stored once, in a chunk table keyed by digest; recipes name them in order. Which ones occur more
often is found by a Spark aggregation over digests and handed to the writers as a Bloom filter of fixed size: a chunk
that the filter takes by mistake is in the chunk table too, so no join and no shuffle carries the bytes of other chunks.
Reading joins the named chunks by digest, checks every digest, and puts payloads together in order.

Stored form of a payload: its recipe (`CDC1`, then for each chunk a byte that says whether the chunk table has it, its length
in four bytes and its digest in sixteen), the compressed bytes of its own chunks, and the chunk table's compressed bodies that
the recipe names, in order. All of it is in files; media_bytes and media_sha256 are of these bytes as they were read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import mix64, shared_dir, sliced, stage, text_bytes

SMALLEST, LARGEST, CUT_BITS, UNIT, FILL, LEVEL = 256, 8192, 10, 576, 255, 9
FILTER_BITS = 25
RECIPES, CHUNKS = "media binary, recipe binary, own binary", "digest binary, body binary"
MAGIC, ENTRY = b"CDC1", 21
with np.errstate(over="ignore"):
    _GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: bytes) -> bytes:
    """The bytes and as many FILL as make a positive multiple of UNIT."""
    return text + bytes([FILL]) * (-len(text) % UNIT if text else UNIT)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        low = h[:-s] << np.uint32(s)
        h[s:] += low
    out, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - last > LARGEST:
            last += LARGEST
            out.append(last)
        if at - last >= SMALLEST:
            out.append(at)
            last = at
    while len(payload) - last > LARGEST:
        last += LARGEST
        out.append(last)
    if last < len(payload):
        out.append(len(payload))
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(digest_of(p), p) for p in parts]


def recipe_of(parts: list[tuple[bytes, bytes]], shared: list[bool]) -> bytes:
    return MAGIC + b"".join(bytes([s]) + len(x).to_bytes(4, "little") + d for (d, x), s in zip(parts, shared, strict=True))


def entries_of(recipe: bytes) -> list[tuple[bool, int, bytes]]:
    """(shared, length, digest) of each chunk in order."""
    if recipe[:4] != MAGIC or (len(recipe) - 4) % ENTRY:
        raise ValueError("not a recipe")
    return [(recipe[k] == 1, int.from_bytes(recipe[k + 1 : k + 5], "little"), recipe[k + 5 : k + ENTRY]) for k in range(4, len(recipe), ENTRY)]


def _known(digest: bytes, words: np.ndarray) -> bool:
    mask = (1 << FILTER_BITS) - 1
    return all(int(words[at >> 6]) >> (at & 63) & 1 for at in (int.from_bytes(digest[k : k + 4], "big") & mask for k in (0, 4)))


def features(payload: bytes, chunks: int) -> str:
    """Of the samples read back: mean, deviation, entropy in bits, sign changes around the mean, chunks."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    above = x > x.mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};turns={int((above[1:] != above[:-1]).sum())};chunks={chunks}"


def catalogue(docs: DataFrame) -> DataFrame:
    """Staged (doc_id, n_bytes, media, digests) for each row of docs (doc_id, text); media: sha256 of the payload."""

    def run(batches):
        for b in sliced(batches):
            size, media, digests = [], [], []
            for t in text_bytes(b["text"]):
                p = payload_of(t)
                size.append(len(t))
                media.append(hashlib.sha256(p).digest())
                digests.append([d for d, _ in chunks_of(p)])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return stage(docs.mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>"), "cdc-catalogue")


def repeated_filter(listed: DataFrame) -> np.ndarray:
    """The Bloom filter of digests that occur more than once: 2^FILTER_BITS bits at most reach the driver."""
    often = listed.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    low, next_ = (F.conv(F.hex(F.substring("d", k, 4)), 16, 10).cast("long") for k in (1, 5))
    mask = 1 << FILTER_BITS
    at = F.explode(F.array(low % mask, next_ % mask)).alias("at")
    words = often.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("held")).toArrow()
    out = np.zeros(mask // 64, np.uint64)
    out[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return out


def store(docs: DataFrame, path: str) -> DataFrame:
    """Writes recipes (media, recipe, own) and chunks (digest, body) to path; returns the catalogue."""
    spark = docs.sparkSession
    listed = catalogue(docs)
    shared = spark.sparkContext.broadcast(repeated_filter(listed))

    def bodies(batches):
        zstd, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        for b in sliced(batches):
            ds, out = [], []
            for t in text_bytes(b["text"]):
                for d, part in chunks_of(payload_of(t)):
                    if d not in seen and _known(d, shared.value):
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(d)
                        ds.append(d)
                        out.append(zstd.compress(part))
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.binary()), pa.array(out, pa.binary())], ["digest", "body"])

    def recipes(batches):
        zstd, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        for b in sliced(batches):
            out = [], [], []
            for t in text_bytes(b["text"]):
                p = payload_of(t)
                parts = chunks_of(p)
                flags = [_known(d, shared.value) for d, _ in parts]
                key = hashlib.sha256(p).digest()
                if all(flags):  # only then can another row have the same payload
                    if key in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                own = b"".join(x for (_, x), f in zip(parts, flags, strict=True) if not f)
                for to, x in zip(out, (key, recipe_of(parts, flags), zstd.compress(own) if own else b""), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["media", "recipe", "own"])

    text = docs.select("text")
    text.mapInArrow(bodies, CHUNKS).dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/chunks")
    text.mapInArrow(recipes, RECIPES).write.option("compression", "none").parquet(f"{path}/recipes")
    return listed


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(recipe: bytes, own: bytes, bodies: list[bytes], unzip) -> tuple:
    rest, at, parts, k = (unzip.decompress(own) if own else b""), 0, [], 0
    for s, n, d in entries_of(recipe):
        if s:
            part, k = unzip.decompress(bodies[k]), k + 1
        else:
            part, at = rest[at : at + n], at + n
        if len(part) != n or digest_of(part) != d:
            raise ValueError("a stored chunk does not match its digest")
        parts.append(part)
    payload, form = b"".join(parts), b"".join([recipe, own, *bodies])
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), features(payload, len(parts))


def _rows(keys: list[bytes], found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([f[n] for f in found], t) for n, t in enumerate(kinds))], READ.replace(",", "").split()[0::2])


def read(spark: SparkSession, path: str) -> DataFrame:
    """READ for each stored payload, put together from its recipe and the chunks it names."""

    def whole(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in sliced(batches):
            rows = b.to_pylist()
            yield _rows([r["media"] for r in rows], [_describe(r["recipe"], r["own"], [], unzip) for r in rows])

    def joined(batches):
        unzip, now, bodies = zstandard.ZstdDecompressor(), None, []

        def done():
            if sum(s for s, _, _ in entries_of(now["recipe"])) != len(bodies):
                raise ValueError("a named chunk is missing")
            return _describe(now["recipe"], now["own"], bodies, unzip)

        for b in sliced(batches):
            keys, out = [], []
            for r in b.to_pylist():
                if r["at"] >= 0:
                    bodies.append(r["body"])
                    continue
                if now is not None:
                    keys.append(now["media"])
                    out.append(done())
                now, bodies = r, []
            if keys:
                yield _rows(keys, out)
        if now is not None:
            yield _rows([now["media"]], [done()])

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    entry = f"{len(MAGIC) + 1} + {ENTRY} * k"
    named_at = f"filter(sequence(0, CAST((length(recipe) - {len(MAGIC)}) / {ENTRY} AS INT) - 1), k -> substring(recipe, {entry}, 1) = X'01')"
    listed = recipes.withColumn("named", F.expr(f"transform({named_at}, k -> struct(substring(recipe, {entry} + 5, 16) AS d, k AS at))"))
    alone = listed.where(F.size("named") == 0).mapInArrow(whole, READ)
    named = listed.where(F.size("named") > 0).dropDuplicates(["media"])
    refs = named.select("media", F.explode("named").alias("e")).select("media", F.col("e.d").alias("digest"), F.col("e.at").alias("at"))
    bodies = refs.join(spark.read.schema(CHUNKS).parquet(f"{path}/chunks"), "digest").select("media", "at", "body", F.lit(None).cast("binary").alias("recipe"), F.lit(None).cast("binary").alias("own"))
    heads = named.select("media", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("body"), "recipe", "own")
    return alone.union(heads.union(bodies).repartition("media").sortWithinPartitions("media", "at").mapInArrow(joined, READ))


def media_query(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) and returns what is read back, for each row.

    Null and empty texts are one unit of FILL; equal texts are one stored payload and have equal values; repeated rows and
    null doc_ids keep their rows; an empty table gives no row; other columns are left out."""
    path = f"{shared_dir(docs.sparkSession)}/strandline/media-{uuid.uuid4().hex}"
    listed = store(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path).select("doc_id", "n_bytes", "media")
    found = read(docs.sparkSession, path)
    return listed.join(found, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
