"""Mixture-controlled packing by deficit round-robin over source queues.

Every queue is one stream of tokens (its documents one after another, each with an end id). A window of `length` tokens
takes from queue q its share of the target, floor(cumulative share) telescoped over the queues, so that what a queue
lacks in one window it gets in a later one: the deficit of each queue stays below one token over any run of windows,
wherever documents and partitions end. When a queue runs dry, one window is filled from the others in proportion and the
shares are worked out anew. Quotas are closed forms of the window's number, so that each document finds its windows by
itself: no task sees a whole queue, and a hot source is cut like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import sliced, stage
from strandline.llm.fast_ids import HALF, encoder

#: Queues of their own at most where no targets are given; the sources beyond, those with the least text, share the queue
#: OTHERS. Targets give every source that they name a queue.
QUEUES, OTHERS = 64, "*"
SHIFT = 20  # shares are multiples of 2^-20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def pick_queues(docs: DataFrame, targets: dict[str, float] | None, length: int) -> list[str]:
    """The sources that get queues of their own: those of targets, else the ones with the most characters."""
    most = min(QUEUES, max(2, length // 4)) - 1
    if targets is not None:
        return sorted(s for s in targets if s is not None)
    sums = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.length("text")).alias("n"))
    return sorted(r["source"] for r in sums.orderBy(F.desc_nulls_last("n"), "source").limit(most).collect())


def balanced_targets(docs: DataFrame, power: float = 0.5) -> dict[str | None, float] | None:
    """Targets between the sources' own sizes and equal parts: (number of documents) ** power; null and empty sources are one,
    under None. The driver holds a number for each source; no documents: None."""
    counts = {r["source"]: r["count"] for r in docs.groupBy(F.col("source").cast("string").alias("source")).count().collect()}
    unnamed = counts.get(None, 0) + counts.get("", 0)
    return {s: n**power if s else n * unnamed ** (power - 1) for s, n in counts.items()} or None


def shares(weights: list[int | float]) -> list[int]:
    """Cumulative shares in 2^-SHIFT, from 0 to 2^SHIFT."""
    total, out, run = sum(weights), [0], 0
    for w in weights:
        run += w
        out.append(round((1 << SHIFT) * run / total))
    return out


def plan_windows(totals: list[int], targets: list[float] | None, length: int) -> list[tuple]:
    """Segments (first window, first position of each queue, cumulative quotas or shares, fixed).

    fixed: one window whose cumulative quotas are given as tokens; else shares hold until the next segment."""
    taken, window, out = [0] * len(totals), 0, []
    while any(t < n for t, n in zip(taken, totals, strict=True)):
        left = [n - t for t, n in zip(taken, totals, strict=True)]
        weights = [(targets[k] if targets else totals[k]) if x else 0 for k, x in enumerate(left)]
        if not sum(weights):
            weights = left
        # A queue takes a token of each window at least, so that its position never runs backwards.
        weights = [max(w, 1.02 * sum(weights) / length) if x else 0 for w, x in zip(weights, left, strict=True)]
        cum = shares(weights)
        each = lambda m, cum=np.array(cum): np.diff(m * length * cum >> SHIFT).tolist()
        low, high = 0, sum(left) // length + 1
        while low < high:  # the most windows that no queue is too short for
            mid = (low + high + 1) // 2
            if all(q <= x for q, x in zip(each(mid), left, strict=True)):
                low = mid
            else:
                high = mid - 1
        if low:
            out.append((window, list(taken), cum, False))
            taken, window = [t + q for t, q in zip(taken, each(low), strict=True)], window + low
            left = [n - t for t, n in zip(taken, totals, strict=True)]
        if any(left):
            room, quota = min(length, sum(left)), [min(q, x) for q, x in zip(each(1), left, strict=True)]
            rest = room - sum(quota)
            for k in sorted(range(len(left)), key=lambda k: -left[k]):
                more = min(rest, left[k] - quota[k])
                quota[k], rest = quota[k] + more, rest - more
            out.append((window, list(taken), [0, *np.cumsum(quota).tolist()], True))
            taken, window = [t + q for t, q in zip(taken, quota, strict=True)], window + 1
    return out


def cut(plan: list[tuple], firsts: list[int], q: int, begin: int, end: int, length: int):
    """Pieces (position in the queue, length, window, offset) of the positions [begin, end) of queue q.

    firsts: the first position of queue q in each segment."""
    k, at = bisect_right(firsts, begin) - 1, begin
    while at < end:
        while k + 1 < len(plan) and firsts[k + 1] <= at:
            k += 1
        window, taken, cum, fixed = plan[k]
        a, b, base = cum[q], cum[q + 1], taken[q]
        stop = min(end, firsts[k + 1]) if k + 1 < len(plan) else end
        if fixed:
            yield at, stop - at, window, a + at - base
            at = stop
            continue
        lo = lambda m: (m * length * b >> SHIFT) - (m * length * a >> SHIFT)
        m = ((at - base) << SHIFT) // (length * (b - a))
        while lo(m) > at - base:
            m -= 1
        while lo(m + 1) <= at - base:
            m += 1
        while at < stop:
            upto = min(stop, base + lo(m + 1))
            if upto > at:
                front = ((m + 1) * length * a >> SHIFT) - (m * length * a >> SHIFT)
                yield at, upto - at, window + m, front + at - base - lo(m)
            at, m = max(at, upto), m + 1


def encode_docs(docs: DataFrame, queues: list[str], tokenizer: str, end_id: int, cache: int = HALF) -> DataFrame:
    """Staged rows (part, queue, first, doc_id, n, ids): first counts the ids of the same queue before it in its part."""
    number = {s: k for k, s in enumerate([OTHERS, *queues])}
    wide = encoder(tokenizer).tok.get_vocab_size() > 65536 or end_id >= 65536

    def run(batches):
        from pyspark import TaskContext

        part, enc, sums = TaskContext.get().partitionId(), encoder(tokenizer, cache), [0] * len(number)
        tail = int(end_id).to_bytes(4, "little")
        for b in sliced(batches):
            out = [], [], [], []
            for source, text in zip(b["source"].to_pylist(), enc.encode_column(b["text"]), strict=True):
                raw = text + tail
                q = number.get(source, 0)
                for to, x in zip(out, (q, sums[q], len(raw) // 4, raw if wide else np.frombuffer(raw, "<u4").astype("<u2").tobytes()), strict=True):
                    to.append(x)
                sums[q] += len(raw) // 4
            yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), b["doc_id"].cast(pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["part", "queue", "first", "doc_id", "n", "ids"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return stage(columns.mapInArrow(run, "part int, queue int, first long, doc_id long, n long, ids binary"), "pack-ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, targets: dict[str, float] | None = None, cache: int = HALF) -> DataFrame:
    """Rows of PIECES: every id of docs (doc_id, source, text) in exactly one piece of one sequence of `length` tokens.

    All sequences but the last are full. targets: token share by source (others: the mean of the targets), default the
    sources' own token shares; the target of None is that of the sources without one and of null sources, else the mean. More
    than length/4 queues share windows of several sequences, so that each has some tokens in them. Null texts are empty and hold the end id; null sources are in the queue OTHERS; repeated
    ids and rows each get pieces; an empty table gives no row; other columns are left out. cache: see FastEncoder."""
    queues = pick_queues(docs, targets, length)
    names = [OTHERS, *queues]
    staged = encode_docs(docs, queues, tokenizer, end_id, cache)
    sums = stage(staged.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-sums")
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stage(sums.select("queue", "part", F.coalesce(before, F.lit(0).cast("long")).alias("base")), "pack-bases")
    totals = [0] * len(names)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # at most QUEUES rows
        totals[r["queue"]] = r["n"]
    weights = None if targets is None else [targets.get(None, sum(targets.values()) / max(1, len(targets))), *(targets[s] for s in queues)]
    span = length * max(1, -(-4 * len(names) // length)) if targets is not None else length
    plan = plan_windows(totals, weights, span)
    firsts = [[seg[1][q] for seg in plan] for q in range(len(names))]
    wide = encoder(tokenizer).tok.get_vocab_size() > 65536 or end_id >= 65536

    def pieces(batches):
        for b in sliced(batches):
            out = [[] for _ in range(8)]
            for q, begin, doc_id, n, ids in zip(b["queue"].to_pylist(), b["begin"].to_pylist(), b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"], strict=True):
                raw = np.frombuffer(ids.as_py(), "<u4" if wide else "<u2").astype("<u4").tobytes()
                for at, run, window, offset in cut(plan, firsts[q], q, begin, begin + n, span):
                    start, place, stop = at - begin, window * span + offset, window * span + offset + run
                    while place < stop:
                        size = min(stop, (place // length + 1) * length) - place
                        for to, x in zip(out, (doc_id, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, place // length, place % length, names[q]), strict=True):
                            to.append(x)
                        start, place = start + size, place + size
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.string())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    placed = staged.join(bases, ["queue", "part"]).select("queue", (F.col("base") + F.col("first")).alias("begin"), "doc_id", "n", "ids")
    return placed.mapInArrow(pieces, PIECES)
