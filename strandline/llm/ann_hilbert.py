"""Approximate nearest neighbours on shifted space-filling curves.

Each of CURVES orderings takes DIMS coordinates of a rotation of the unit vectors (rotations are fixed by the curve's
number), shifts them, and walks them along a Hilbert curve. Its keys are cut at quantiles into blocks; a query is sent to
the blocks of its window around its own key, scored there against whole blocks by inner product in double precision, and the
nearest of all curves are merged. Blocks are dealt by Spark range partitioning over (curve, block), so that neighbouring
windows meet in neighbouring partitions. Equal vectors are one row of the search and are opened afterwards by their smallest
ids, so that copies crowd out nobody.

The window is a share of the blocks (WINDOW) on each side. Directions that carry no structure, such as independent
normal components, leave no ordering a better choice: their recall is bought by the share that is scored, and the cost of
a query grows with the table. Clustered vectors can do with fewer and narrower windows; both are parameters. Blocks are as
many as keep them at BLOCK_ROWS rows, but no more than BLOCKS until they reach WIDEST rows: before that a query is copied to
three blocks of a curve at most, whatever the table, and the driver holds a bound for each WIDEST rows of a large one. Vectors
of floats travel as floats and are multiplied as doubles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stage

CURVES, DIMS, BITS, BLOCK_ROWS, WINDOW = 12, 6, 10, 256, 0.046
BLOCKS, WIDEST = 32, 1 << 15


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows, dimensions), each below 2^bits."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the curve's reflections and exchanges, from coarse to fine
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] & (one << np.uint64(b))) != 0, t ^ ((one << np.uint64(b)) - one), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curves: int = CURVES) -> np.ndarray:
    """Keys of unit-normed rows on every curve: (curves, rows)."""
    dim = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    use, out = min(DIMS, dim), []
    for c in range(curves):
        rng = np.random.default_rng([dim, c])
        axes = np.linalg.qr(rng.standard_normal((dim, use)))[0]
        shift = rng.random(use)
        spread = 0.5 + np.arctan(unit @ axes * math.sqrt(dim)) / math.pi  # even enough over (0, 1)
        cells = np.floor((0.5 * spread + 0.5 * shift) * ((1 << BITS) - 1))
        out.append(hilbert_keys(cells, BITS))
    return np.array(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, curves: int = CURVES, window: float = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of rows (vec_id, embedding) for each of queries.

    Queries are rows too and never find themselves. Nearest first, ties to the smaller vec_id; all, if fewer. Vectors
    that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids; vectors of different
    lengths do not meet. Repeated rows count as one. Empty tables give no row; other columns are left out."""
    spark = rows.sparkSession
    single = all(df.schema["embedding"].dataType.elementType.typeName() == "float" for df in (queries, rows))
    kind = "<f4" if single else "<f8"

    def valid(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b["vec_id"].to_pylist(), b["embedding"].to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    def clean(df):
        return df.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(valid, "vec_id long, vec binary").withColumn("h", F.xxhash64("vec"))

    first = F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))
    kept = clean(rows).withColumn("n", first).where(F.col("n") <= k + 1)  # Spark limits the groups before the shuffle too
    table = stage(kept.groupBy("h", "vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ann-rows")
    asked = stage(clean(queries).select("vec_id", "h").distinct(), "ann-queries")
    total = table.count()
    blocks = max(1, min(-(-total // block_rows), BLOCKS), -(-total // WIDEST))
    sides = max(1, round(window * blocks))

    def keys(batches):
        for b in batches:
            vecs, place = b["vec"].to_pylist(), {}
            for n, v in enumerate(vecs):
                place.setdefault(len(v), []).append(n)
            for size, at in place.items():
                x = np.array([np.frombuffer(vecs[n], kind) for n in at], np.float64)
                for c, key in enumerate(curve_keys(x, curves)):
                    yield pa.RecordBatch.from_arrays([pa.array([c + (size << 16)] * len(at), pa.int64()), pa.array(key), pa.array(b["h"].to_numpy()[at])], ["curve", "key", "h"])

    keyed = stage(table.mapInArrow(keys, "curve long, key long, h long"), "ann-keys")
    # At most `blocks` bounds for each curve: quantiles of the keys, by a mergeable sketch.
    cuts = keyed.groupBy("curve").agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks).alias("cuts"))
    bounds = {r["curve"]: np.array(r["cuts"] if blocks > 1 else [], np.int64) for r in cuts.collect()}
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches):
        for b in batches:
            curve, key = b["curve"].to_numpy(), b["key"].to_numpy()
            at = np.zeros(len(key), np.int64)
            for c in np.unique(curve):
                on = curve == c
                at[on] = np.searchsorted(shared.value[c], key[on], side="right")
            yield pa.RecordBatch.from_arrays([b["curve"], pa.array(at), b["h"]], ["curve", "block", "h"])

    dealt = keyed.mapInArrow(deal, "curve long, block long, h long")
    points = dealt.join(table.select("h", "vec", "ids"), "h").select("curve", "block", F.lit(True).alias("is_row"), "h", "vec", "ids")
    near = F.explode(F.sequence(F.greatest(F.col("block") - sides, F.lit(0)), F.least(F.col("block") + sides, F.lit(blocks - 1)))).alias("block")
    wanted = dealt.join(asked.select("h").distinct(), "h").select("curve", near, "h").join(table.select("h", "vec"), "h")
    wanted = wanted.select("curve", "block", F.lit(False).alias("is_row"), "h", "vec", F.lit(None).cast("array<long>").alias("ids"))

    def search(batches):
        group, rows_, ids, ask, who = None, [], [], [], []

        def answer():
            if not rows_ or not ask:
                return None
            x, q = (np.frombuffer(b"".join(vs), kind).reshape(len(vs), -1).astype(np.float64) for vs in (rows_, ask))
            take = min(len(x), k + 1)
            out = []
            step = max(1, 4_000_000 // len(x))  # 32 MB of scores at once
            for lo in range(0, len(q), step):
                s = q[lo : lo + step] @ x.T
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                edge = np.take_along_axis(s, top, 1).min(1)
                for n in range(len(s)):
                    at = top[n] if (s[n] >= edge[n]).sum() == take else np.flatnonzero(s[n] >= edge[n])
                    if len(at) > take:  # ties at the edge go to the smaller ids
                        at = sorted(at, key=lambda j: (-s[n, j], ids[j][0]))[:take]
                    out.append((who[lo + n], [i for j in at for i in ids[j]], [float(np.dot(q[lo + n], x[j])) for j in at for _ in ids[j]]))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["h", "ids", "scores"])

        for b in batches:
            for c, at, is_row, h, vec, i in zip(*(b[n].to_pylist() for n in ("curve", "block", "is_row", "h", "vec", "ids")), strict=True):
                if (c, at) != group:
                    if (done := answer()) is not None:
                        yield done
                    group, rows_, ids, ask, who = (c, at), [], [], [], []
                if is_row:
                    rows_.append(vec)
                    ids.append(i)
                else:
                    ask.append(vec)
                    who.append(h)
        if (done := answer()) is not None:
            yield done

    parts = max(1, min(blocks * curves, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = points.union(wanted).repartitionByRange(parts, "curve", "block").sortWithinPartitions("curve", "block")
    found = both.mapInArrow(search, "h long, ids array<long>, scores array<double>")

    def merge(batches):
        now, best = None, {}

        def top():
            order = sorted(best.items(), key=lambda e: (-e[1], e[0]))[: k + 1]
            return now, [i for i, _ in order], [s for _, s in order]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["h", "ids", "scores"])

        for b in batches:
            out = []
            for h, ids, scores in zip(b["h"].to_pylist(), b["ids"].to_pylist(), b["scores"].to_pylist(), strict=True):
                if h != now:
                    if now is not None:
                        out.append(top())
                    now, best = h, {}
                best.update(zip(ids, scores, strict=True))
            if out:
                yield batch(out)
        if now is not None:
            yield batch([top()])

    merged = found.repartition("h").sortWithinPartitions("h").mapInArrow(merge, "h long, ids array<long>, scores array<double>")
    pairs = asked.join(stage(merged, "ann-found"), "h").select(F.col("vec_id").alias("query_id"), F.filter(F.arrays_zip("ids", "scores"), lambda e: e["ids"] != F.col("vec_id")).alias("near"))
    return pairs.select("query_id", F.posexplode(F.slice("near", 1, k))).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score"))
