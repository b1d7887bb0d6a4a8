"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

A source's documents, in a fixed pseudo-random order, are cut into blocks. With weight w its block j (from 0) is released
at slot floor(j/w) and due by slot ceil((j+1)/w); each slot goes to the released block with the earliest deadline. Slots
are global and weights the targets themselves, as multiples of 1/WHOLE, so that the number of a source's blocks in any
prefix of the slots is less than one block from the prefix's length times its weight. Sources are scheduled as if they
never ran out; slots of a source that has run out stay empty.

The slots are scheduled in frames, many at once. At a frame's bound every source has the blocks that are due and some of
those that are released and not due: those with the earliest middle of release and deadline, as many as slots are left.
Inside a frame the earliest deadline goes first. A frame that cannot keep a deadline, or not end in the next one's state,
gets other bounds (a part of a frame later) until all hold; no block is placed outside of its window.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import stage

FRAME, BLOCK = 512, 32
#: Weights are multiples of 1/WHOLE; below SLOTS slots no product leaves 64 bits.
WHOLE, SLOTS = 1 << 31, 1 << 32
#: Rows that one sub-queue of a source has, in the mean.
BUCKET_ROWS = 512
#: Places that a frame's bound is tried at, before all slots become one frame.
PLACES = 8


def whole_weights(sizes: dict[str, int], targets: dict[str, float] | None, power: float, whole: int = WHOLE) -> dict[str, int]:
    """Weights in 1/whole by source, at least 1, their sum whole: each less than 1 from the target, by largest remainders; the
    largest also gives what sources below 1 take. So over t slots a source is at most t / whole blocks from its target, besides
    what the schedule itself deviates.

    targets: weights by source, others the least of them; default n ** power of each source."""
    least = min(targets.values()) if targets else 0
    raw = {s: Fraction(float(targets.get(s, least) if targets is not None else n**power)) for s, n in sorted(sizes.items())}
    total = sum(raw.values())
    exact = {s: x * whole / total for s, x in raw.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = whole - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(left, 0)]:
        out[s] += 1
    if left < 0:
        out[max(out, key=out.get)] += left
    return out


def _bounds(rows: DataFrame, weights: list[int], whole: int, frame: int) -> DataFrame:
    """(f, place, t, n) of rows (f, place): the bound's slot and the blocks that each source has by then."""
    at = rows.withColumn("t", F.when(F.col("f") == 0, F.lit(0).cast("long")).otherwise(F.col("f") * frame + F.col("place") * max(1, frame // PLACES)))
    at = at.withColumn("w", F.lit(weights).cast("array<bigint>"))
    due = at.withColumn("n", F.expr(f"transform(w, x -> (t * x) div {whole}L)")).withColumn("left", F.expr("t - aggregate(n, 0L, (s, x) -> s + x)"))
    open_ = f"filter(transform(w, (x, k) -> struct((2 * n[k] + 1) / double(x) AS middle, k AS k, (t * x) % {whole}L > 0 AS released)), e -> e.released)"
    ahead = due.withColumn("ahead", F.expr(f"transform(slice(array_sort({open_}), 1, int(left)), e -> e.k)"))
    return ahead.select("f", "place", "t", F.expr("transform(n, (x, k) -> x + if(array_contains(ahead, k), 1L, 0L))").alias("n"))


def _framed(bounds: DataFrame, weights: list[int], whole: int, free: bool = False) -> DataFrame:
    """(f, kept, picks) for every two bounds that follow each other: the frame's slots by earliest deadline first. free: a
    frame need not end in the next one's state, and so keeps every deadline up to its end."""
    ends = bounds.select((F.col("f") - 1).alias("f"), F.col("t").alias("t1"), F.expr(f"transform(n, x -> x + {SLOTS if free else 0}L)").alias("n1"))
    frames = bounds.select("f", F.col("t").alias("t0"), F.col("n").alias("n0")).join(ends, "f").withColumn("w", F.lit(weights).cast("array<bigint>"))
    released = f"s.n[k] < n1[k] AND (s.n[k] * {whole}L) div w[k] <= t"
    first = f"array_min(transform(filter(sequence(0, {len(weights) - 1}), k -> {released}), k -> struct(least(t1, ((s.n[k] + 1) * {whole}L + w[k] - 1) div w[k]) AS due, k AS k)))"
    pick = "struct(b.k AS k, s.n[b.k] AS j, t AS slot)"
    step = f"""transform(array({first}), b -> named_struct('n', if(b IS NULL, s.n, transform(s.n, (x, k) -> if(k = b.k, x + 1, x))),
      'picks', if(b IS NULL, s.picks, concat(s.picks, array({pick}))), 'kept', s.kept AND b IS NOT NULL AND b.due > t))[0]"""
    none = "named_struct('n', n0, 'picks', cast(array() AS array<struct<k: int, j: bigint, slot: bigint>>), 'kept', true)"
    done = frames.withColumn("done", F.expr(f"aggregate(sequence(t0, t1 - 1), {none}, (s, t) -> {step})"))
    return done.select("f", F.expr("done.kept AND done.n = n1").alias("kept"), F.expr("done.picks").alias("picks"))


def schedule(spark: SparkSession, weights: dict[str, int], whole: int, blocks: dict[str, int], frame: int = FRAME) -> DataFrame:
    """(source, j, slot, release, deadline) for the first blocks[source] blocks of each source."""
    names, w = list(weights), list(weights.values())
    kinds = "f long, kept boolean, picks array<struct<k: int, j: bigint, slot: bigint>>"
    if not names:
        frames = spark.createDataFrame([], kinds)
    else:
        slots = max(-(-blocks[s] * whole // x) for s, x in weights.items())
        if slots >= SLOTS:
            raise ValueError(f"{slots} slots: take larger blocks, or weights nearer to the sources' sizes")
        several = -(-slots // frame)
        rows = spark.range(several + 1).select(F.col("id").alias("f"), F.lit(0).alias("place"))
        frames = stage(_framed(_bounds(rows, w, whole, frame), w, whole), "mix-frames")
        for _ in range(PLACES):
            bad = frames.where("NOT kept").select("f")
            if bad.isEmpty():
                break
            moved = bad.union(bad.select(F.col("f") + 1)).distinct().withColumn("moved", F.lit(1))
            rows = stage(rows.join(moved, "f", "left").select("f", (F.col("place") + F.coalesce("moved", F.lit(0))).alias("place")), "mix-places")
            touched = moved.select("f").union(moved.select(F.col("f") - 1)).distinct()
            bounds = rows.join(touched.union(touched.select(F.col("f") + 1)).distinct(), "f", "left_semi")
            again = _framed(_bounds(bounds, w, whole, frame), w, whole).join(touched, "f", "left_semi")
            frames = stage(frames.join(touched, "f", "left_anti").union(again), "mix-frames")
        else:
            whole_run = spark.range(2).select(F.col("id").alias("f"), F.lit(0).alias("place"))
            frames = stage(_framed(_bounds(whole_run, w, whole, several * frame), w, whole, free=True), "mix-frames")
    picks = frames.select(F.explode("picks").alias("p")).select("p.k", "p.j", "p.slot")
    picks = picks.withColumn("w", F.lit(w or [1]).cast("array<bigint>")).withColumn("held", F.lit([blocks[s] for s in names] or [0]).cast("array<bigint>"))
    picks = picks.withColumn("source", F.lit(names or [""]).cast("array<string>")[F.col("k")]).where("j < held[k]")
    return picks.select("source", "j", "slot", F.expr(f"(j * {whole}L) div w[k]").alias("release"), F.expr(f"((j + 1) * {whole}L + w[k] - 1) div w[k]").alias("deadline"))


def frame_schedule(quotas: DataFrame) -> DataFrame:
    """(source, j, slot, release, deadline) of one frame in which each source has its quota of blocks: quotas (source, quota, frame)."""
    rows = {r["source"]: (r["quota"], r["frame"]) for r in quotas.collect()}
    held = {s: rows[s][0] for s in sorted(rows)}
    whole = next(iter(rows.values()))[1] if rows else 1
    return schedule(quotas.sparkSession, held, whole, held, whole)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK, frame: int = FRAME, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of docs (source, doc_id, text, ...) once: columns, source, source_rank, block, release, deadline, slot,
    position (slot * block + place in the block), all from 0. Where columns name source, it is the one of docs.

    A source is cut into sub-queues of about BUCKET_ROWS rows by a hash of the row, so that a hot source is ranked in many
    tasks; ranks follow the sub-queues, then the hash. The driver holds a number for each source. Null sources are one
    source named "" of their own; rows alike in all of source, doc_id and text are ranked side by side; a null doc_id is
    hashed like any other; an empty table gives no row. Other columns of docs are left out."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keep = [F.col(c).alias(f"_{c}") for c in columns]
    base = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").alias("_order"), h.alias("h"), *keep)
    sizes = stage(docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).groupBy("source").agg(F.count("*").alias("n")), "mix-sizes")
    base = base.join(F.broadcast(sizes.select("source", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))), "source")  # a row for each source
    base = base.withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets"))).drop("buckets")
    local = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "_order")).cast("long") - 1
    ranked = base.withColumn("local", local)
    counts = base.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source", "bucket", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    rows = {r["source"]: r["n"] for r in sizes.collect()}  # a row for each source
    plan = schedule(docs.sparkSession, whole_weights(rows, targets, power), WHOLE, {k: -(-n // block) for k, n in rows.items()}, frame)
    turn = ranked.join(offsets, ["source", "bucket"]).withColumn("source_rank", F.col("before") + F.col("local"))
    turn = turn.withColumn("block", F.floor(F.col("source_rank") / block))
    placed = turn.join(plan.withColumnRenamed("j", "block"), ["source", "block"])
    return placed.select(*[F.col(f"_{c}").alias(c) for c in columns], *([] if "source" in columns else ["source"]), "source_rank", "block", "release", "deadline", "slot", (F.col("slot") * block + F.col("source_rank") % block).alias("position"))
