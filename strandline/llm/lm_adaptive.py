"""Adaptive prediction by partial matching: each document starts with an empty trie and learns as it is coded."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import sliced, text_bytes
from strandline.llm.lm_ppm import BOUNDARY, DISCOUNT, plain


def adaptive_log10(text: bytes, order: int = 3) -> float:
    """log10 probability of the bytes and an end symbol, escapes and exclusion as in lm_ppm, counts of this text so far."""
    tries: dict[bytes, dict[int, int]] = {}
    out = 0.0
    for at in range(len(text) + 1):
        symbol = text[at] if at < len(text) else BOUNDARY
        gone: set[int] = set()
        for k in range(min(order, at), -2, -1):
            if k < 0:
                out -= math.log10(257 - len(gone))
                break
            counts = tries.get(text[at - k : at])
            if not counts:
                continue
            open_ = {s: n for s, n in counts.items() if s not in gone}
            if not open_:
                continue
            total = sum(open_.values())
            if symbol in open_:
                out += math.log10((open_[symbol] - DISCOUNT) / total)
                break
            out += math.log10(DISCOUNT * len(open_) / total)
            gone |= set(open_)
        for k in range(min(order, at) + 1):
            seen = tries.setdefault(text[at - k : at], {})
            seen[symbol] = seen.get(symbol, 0) + 1
    return out


def adaptive_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, n_bytes, score (log10) of each row of docs (doc_id, text), nothing learnt across rows; null: empty.

    The trie of a document is at most order + 1 entries for each of its bytes, and goes with it."""

    def run(batches):
        for b in sliced(batches):
            texts = plain(text_bytes(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([adaptive_log10(t, order) for t in texts], pa.float64())], ["doc_id", "n_bytes", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, score double")
