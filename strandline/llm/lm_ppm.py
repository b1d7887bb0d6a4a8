"""Language-model scores by prediction by partial matching over bytes.

Symbols are the 256 bytes and BOUNDARY, which stands before a text (as often as contexts reach back) and ends it. The
corpus is counted as grams of ORDER + 1 symbols; every shorter context's counts are sums of those, so the symbols seen
after a context are also seen after its suffixes and exclusion sets are nested. Every context that MIN_COUNT training
symbols follow is a node of the trie, at any corpus size: the trie grows with the corpus and no worker holds all of it.

1. Documents are read in batches of about BATCH bytes. A batch gives its distinct grams and words with their counts in
   training texts, sorted and packed, one row for each bucket; buckets grow in number with the corpus.
2. A bucket holds all grams whose contexts have the same end, from all batches: the trie's levels from LOW on are sums
   there, those below are one table of at most 257^LOW counts. Each batch's grams get their prices back.
3. A batch's prices and texts meet in one task, which goes through the texts.

A symbol's probability (T: the node's total, D: its distinct symbols, d: DISCOUNT): (n-d)/T at the longest node, else
escape dD/T to the suffix, where the symbols of the longer node are excluded from T and D; below order 0 the rest of the
257 symbols are equally likely. d = 0.5 is escape method D. A text is scored as its tokens joined by single blanks.
With fixed counts this depends on the gram alone. Model is the same trie in one table, for corpora that one worker holds;
there a context needs 1 in MAX_CONTEXTS training symbols.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_rows, mix64, sliced, stage, text_bytes
from strandline.llm.dedup_oph import word_hashes

ORDER, MAX_CONTEXTS, BOUNDARY, DISCOUNT = 6, 1 << 17, 256, 0.4
#: Symbols that must follow a context; bytes of text in a batch and, in the mean, behind a bucket.
MIN_COUNT, BATCH, BUCKET = 2, 64_000_000, 16_000_000
#: Keys that wait to be merged; bytes of text that are counted, stored and scored at once.
PENDING, SLICE = 1_000_000, 500_000
#: Orders below this are counted as one table that every bucket has.
LOW = 3
ROWS = "kind byte, batch long, bucket long, keys binary, n binary, doc_id array<long>, held_out array<boolean>, sizes array<long>, texts binary"
VALUES = "batch long, kind byte, bucket long, keys binary, value binary"
_BITS = 9
#: The end token's key among the words' hashes.
END_WORD = 0
_CHUNK = 1_000_000
#: Grams that are priced at once.
_SPAN = 200_000
#: Parts of a batch's keys, each some whole buckets: what merging, packing and looking up copy is one part.
PARTS = 16
#: Buckets of a small corpus, so that a row of a batch's grams stays below half a MB (beyond that the JVM takes whole regions).
BUCKETS = 128
#: Rows in an Arrow batch: texts to be read, packed rows.
TEXT_ROWS, PACKED_ROWS = 1000, 16


def plain(texts: list[bytes]) -> list[bytes]:
    """Lower-cased tokens joined by blanks."""
    return [b" ".join(t.lower().split()) for t in texts]


def symbols(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with boundaries between, where each text begins, and its length with its end."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = order + np.concatenate([[0], np.cumsum(lengths + order)])[:-1]
    raw = np.frombuffer(b"\0" * order + b"".join(t + b"\0" * order for t in texts), np.uint8)
    out = raw.astype(np.uint16)
    for k in range(order):
        out[begin + lengths + k] = BOUNDARY
    out[:order] = BOUNDARY
    return out, begin, lengths + 1


def positions(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Keys of the grams that end at each symbol of each text, the last symbol in the lowest bits."""
    all_, begin, lengths = symbols(texts, order)
    wide = all_.astype(np.int64)
    key = wide.copy()
    for k in range(1, order + 1):
        key[k:] |= wide[:-k] << (_BITS * k)
    return key[positions(begin, lengths)]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merged() of two such results, the second small: the first is copied once and never sorted again. Its counts are changed."""
    at = np.searchsorted(keys, more)
    held = at < len(keys)
    held[held] = keys[at[held]] == more[held]
    counts[at[held]] += n[held]
    at, new = at[~held], ~held
    return (np.insert(keys, at, more[new]), np.insert(counts, at, n[new])) if len(at) else (keys, counts)


class Tally:
    """Counts of int64 keys, merged as they come, given out when they are many."""

    def __init__(self, kind: int, most: int = 3_000_000):
        self.kind, self.most, self.parts, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray):
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.size += len(got[0])
        if self.size > self.most:
            self.parts = [merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > self.most // 2:
                yield from self.flush()

    def flush(self):
        if self.parts:
            keys, counts = merged(self.parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int8)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])
        self.parts, self.size = [], 0


def chunks(texts: list[bytes], most: int = _CHUNK):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Staged (kind, key, n): kind 0 words by hash, kind 1 grams, of all rows of docs(text)."""

    def run(batches):
        words, seen = Tally(0), Tally(1)
        for b in sliced(batches):
            for texts in chunks(text_bytes(b["text"])):
                texts = plain(texts)
                hashes, _ = word_hashes(texts)
                yield from words.add(np.concatenate([hashes.view(np.int64), np.full(len(texts), END_WORD, np.int64)]))
                yield from seen.add(grams(texts, order))
        yield from words.flush()
        yield from seen.flush()

    found = docs.mapInArrow(run, "kind byte, key long, n long")
    return stage(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


class Model:
    """The trie as flat arrays: child[node, column of the symbol before], cost[node, column of the symbol] (log10)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """levels[k]: contexts of order k (keys), symbols, counts; each context's suffix is in the level before."""
        used = np.unique(levels[0][1]) if len(levels[0][1]) else np.zeros(0, np.int64)
        self.unseen = 257 - len(used)
        self.column = np.full(257, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        width = len(used) + 1
        costs, children, first = [], [], 0
        last: dict = {}
        for k, (ctx, sym, n) in enumerate(levels):
            keys, row = np.unique(ctx, return_inverse=True)
            if k == 0 and not len(keys):
                keys = np.zeros(1, np.int64)
            if not len(keys):
                break
            count = np.zeros((len(keys), width))
            count[row, self.column[sym]] = n
            seen = count > 0
            total, kinds = count.sum(1), seen.sum(1)
            if k == 0:
                rest = np.full((1, width), 1.0 / max(1, self.unseen))
            else:
                up = np.searchsorted(last["keys"], keys & ((1 << (_BITS * (k - 1))) - 1))
                left = np.where(seen, 0.0, last["count"][up])
                open_ = (left > 0).sum(1)
                den = left.sum(1)
                safe = np.maximum(den, 1.0)[:, None]
                rest = np.where(left > 0, (left - DISCOUNT) / safe, np.where(den > 0, DISCOUNT * open_ / np.maximum(den, 1.0), 1.0)[:, None] * last["rest"][up])
                front = keys >> (_BITS * (k - 1))
                children[k - 1][up, self.column[front]] = first + np.arange(len(keys))
            all_ = np.maximum(total, 1.0)[:, None]
            escape = np.where(total > 0, DISCOUNT * kinds / all_[:, 0], 1.0)[:, None]
            probability = np.where(seen, (count - DISCOUNT) / all_, escape * rest)
            with np.errstate(divide="ignore"):
                costs.append(np.log10(probability).astype(np.float32))
            children.append(np.full((len(keys), width), -1, np.int32))
            last, first = {"keys": keys, "count": count, "rest": rest}, first + len(keys)
        # The last row of child is where a walk that has left the trie stays.
        self.width, self.order, self.dead = width, len(costs) - 1, first
        self.cost = np.concatenate(costs).ravel()
        self.child = np.concatenate([*children, np.full((1, width), -1, np.int32)])
        self.child[self.child < 0] = self.dead
        self.child = self.child.ravel()

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text (as plain() gives it) with its end."""
        if not texts:
            return np.zeros(0)
        all_, begin, lengths = symbols(texts, max(1, self.order))
        column, at = np.take(self.column, all_), positions(begin, lengths)
        node, walk = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for k in range(1, self.order + 1):
            walk = np.take(self.child, walk * np.int64(self.width) + np.take(column, at - k))
            node = np.where(walk != self.dead, walk, node)
        cost = np.take(self.cost, node * np.int64(self.width) + np.take(column, at)).astype(np.float64)
        return np.add.reduceat(cost, np.concatenate([[0], np.cumsum(lengths)])[:-1])


def fit(counts: DataFrame, order: int = ORDER, max_contexts: int = MAX_CONTEXTS) -> Model:
    """The trie from counted grams. Of each order at most max_contexts rows of 257 counts reach the driver."""
    known = counts.where("kind = 1")
    total = known.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(total / max_contexts))
    levels, now = [], known.select("key", "n")
    for k in range(order, -1, -1):
        if k < order:
            now = now.groupBy(F.col("key").bitwiseAND((1 << (_BITS * (k + 1))) - 1).alias("key")).agg(F.sum("n").alias("n"))
        now = stage(now, "ppm-grams")
        split = now.select(F.shiftright("key", _BITS).alias("ctx"), F.col("key").bitwiseAND((1 << _BITS) - 1).alias("sym"), "n")
        frequent = split.groupBy("ctx").agg(F.sum("n").alias("total")).where(F.col("total") >= least).select("ctx")
        got = split.join(frequent, "ctx", "left_semi").toArrow()
        levels.append(tuple(got[c].to_numpy().astype(np.int64) for c in ("ctx", "sym", "n")))
    return Model(levels[::-1])


def packed(keys: np.ndarray) -> bytes:
    """Integers, sorted or not, as the differences' bytes plane by plane, compressed."""
    deltas = np.diff(keys.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(deltas.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.int64).ravel())


def _mask(symbols_: int) -> int:
    return (1 << (_BITS * symbols_)) - 1


def _dealt(keys: np.ndarray, buckets: int, order: int | None) -> np.ndarray:
    """The bucket of each key: of a gram by the end of its context, so that all levels from LOW on are in one bucket. Where
    buckets is a multiple of PARTS, a bucket's remainder is what PARTS buckets give."""
    x = keys.view(np.uint64) if order is None else ((keys >> _BITS) & _mask(min(order, LOW))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix64(x + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)


class Held:
    """A batch's distinct keys and their counts, in PARTS parts by bucket; keys wait in `since` until they are many."""

    def __init__(self, buckets: int, order: int | None):
        self.buckets, self.order, self.since, self.size = buckets, order, [], 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint32)) for _ in range(PARTS)]

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.since.append((keys, counts))
        self.size += len(keys)
        if self.size > PENDING:
            self.settle()

    def _split(self, keys: np.ndarray, buckets: int):
        at = _dealt(keys, buckets, self.order)
        sort = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
        at = at[sort]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        return zip(at[first].tolist(), np.split(sort, first[1:]), strict=False)

    def settle(self):
        if self.since:
            keys, counts = merged(self.since)
            self.since, self.size = [], 0
            for k, own in self._split(keys, PARTS):
                held, self.parts[k] = self.parts[k], None
                self.parts[k] = added(*held, keys[own], counts[own].astype(np.uint32))

    def given_up(self):
        """(bucket, keys, counts) of each bucket, keys in order; a part is given up as it is read."""
        self.settle()
        for k in range(PARTS):
            (keys, counts), self.parts[k] = self.parts[k], None
            for bucket, own in self._split(keys, self.buckets):
                yield bucket, keys[own], counts[own].astype(np.int64)


def read_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Staged rows of docs (doc_id, text, held_out) with the batch they fell into.

    kind 0: distinct words by hash of a batch that fall into one bucket, kind 1: grams alike; keys sorted and packed, n: how
    often each is in texts not held out, from 0. kind 2: some documents, their texts one after another, compressed. kind 3:
    counts of the LOW last symbols of grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, PARTS * -(-size // (PARTS * BUCKET)))
    types = {"kind": pa.int8(), "batch": pa.int64(), "bucket": pa.int64(), "keys": pa.binary(), "n": pa.binary(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "texts": pa.binary()}

    def run(batches):
        from pyspark import TaskContext

        batch, held, any_ = TaskContext.get().partitionId() << 20, 0, False
        room = [Held(buckets, None), Held(buckets, order)]  # words and grams
        zstd = zstandard.ZstdCompressor(level=3)

        def rows(kind, size, /, **columns):
            fixed = {"kind": pa.array(np.full(size, kind, np.int8)), "batch": pa.array(np.full(size, batch))}
            return pa.RecordBatch.from_arrays([fixed[c] if c in fixed else columns[c] if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))

        def flush():
            # A batch's grams are the most that a worker holds: all that goes over them goes over a part, or a bucket, at a time.
            for kind in (0, 1):
                low = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for bucket, keys, n in room[kind].given_up():
                    if kind:
                        low.append(merged([(keys[n > 0] & _mask(min(order, LOW)), n[n > 0])]))
                    yield rows(kind, 1, bucket=pa.array([bucket]), keys=pa.array([packed(keys)], pa.binary()), n=pa.array([packed(n)], pa.binary()))
                if kind:
                    keys, n = merged(low)
                    yield rows(3, 1, bucket=pa.array([batch % 16]), keys=pa.array([packed(keys)], pa.binary()), n=pa.array([packed(n)], pa.binary()))

        def add(kind, trained, other):
            room[kind].add(*np.unique(trained, return_counts=True))
            seen = np.unique(other)
            room[kind].add(seen, np.zeros(len(seen), np.int64))

        for b in sliced(batches):
            at = 0
            for raw in chunks(text_bytes(b["text"]), SLICE):
                part, at, texts = b.slice(at, len(raw)), at + len(raw), plain(raw)
                if held > BATCH:
                    yield from flush()
                    batch, held, room = batch + 1, 0, [Held(buckets, None), Held(buckets, order)]
                each = {"doc_id": [part["doc_id"].to_pylist()], "held_out": [part["held_out"].to_pylist()], "sizes": [[len(t) for t in texts]], "texts": [zstd.compress(b"".join(texts))]}
                yield rows(2, 1, **{c: pa.array(x, types[c]) for c, x in each.items()})
                out = each["held_out"][0]
                split = [t for t, h in zip(texts, out, strict=True) if not h], [t for t, h in zip(texts, out, strict=True) if h]
                end = [np.full(len(x), END_WORD, np.int64) for x in split]
                add(0, *(np.concatenate([word_hashes(x)[0].view(np.int64), e]) for x, e in zip(split, end, strict=True)))
                add(1, *(grams(x, order) for x in split))
                held, any_ = held + sum(map(len, texts)), True
        if any_:
            yield from flush()

    parts = max(1, -(-size // BATCH))
    few = docs.coalesce(parts) if parts > 1 else docs
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return stage(few.mapInArrow(run, ROWS), "ppm-corpus")


def prices(levels: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """log10 probability of the last symbol of each gram in asked. levels[k]: sorted grams of k + 1 symbols and their counts;
    all that share asked grams' endings must be there."""

    def find(keys, x):
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    tables: list[tuple] = []
    for k, (pairs, n) in enumerate(levels):
        if not len(pairs):
            break
        ctx = pairs >> _BITS
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        ctx, total, kinds, den, open_ = ctx[first], np.add.reduceat(n, first).astype(float), np.diff(np.append(first, len(pairs))), None, None
        if tables:
            # What the suffix has beyond the symbols that this context has itself.
            b_pairs, b_n, b_ctx, b_total, b_kinds, *_ = tables[-1]
            own, _ = find(b_pairs, pairs & ((1 << (_BITS * k)) - 1))
            up, _ = find(b_ctx, ctx & ((1 << (_BITS * (k - 1))) - 1))
            den, open_ = b_total[up] - np.add.reduceat(b_n[own], first), b_kinds[up] - kinds
        tables.append((pairs, n, ctx, total, kinds, den, open_))
    out = np.empty(len(asked))
    for span in range(0, len(asked), _SPAN):
        some = asked[span : span + _SPAN]
        p = rest = np.full(len(some), 1.0 / max(1, 257 - len(levels[0][0])))
        b_n = b_place = b_seen = None
        for k, (pairs, n, ctx, total, kinds, den, open_) in enumerate(tables):
            at, held = find(ctx, (some >> _BITS) & ((1 << (_BITS * k)) - 1))
            held &= total[at] >= (least if k else 1)
            place, seen = find(pairs, some & ((1 << (_BITS * (k + 1))) - 1))
            if k:
                safe = np.maximum(den, 1.0)[at]
                lower = np.where(b_seen, (b_n[b_place] - DISCOUNT) / safe, np.where(den[at] > 0, DISCOUNT * open_[at] / safe, 1.0) * rest)
                rest = np.where(held, lower, rest)
            p = np.where(held, np.where(seen, (n[place] - DISCOUNT) / total[at], DISCOUNT * kinds[at] / total[at] * rest), p)
            b_n, b_place, b_seen = n, place, seen
        out[span : span + _SPAN] = np.log10(p)
    return out


def short_counts(corpus: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The LOW last symbols of all training grams, sorted, and their counts: at most 257^LOW, whatever the corpus."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = merged([(unpacked(k), unpacked(x)) for k, x in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)])
        return pa.table({"keys": pa.array([packed(keys)], pa.binary()), "n": pa.array([packed(n)], pa.binary())})

    found = corpus.where("kind = 3").select("bucket", "keys", "n").groupBy("bucket").applyInArrow(run, "keys binary, n binary").toArrow()
    none = np.zeros(0, np.int64)
    return merged([(none, none), *((unpacked(k), unpacked(x)) for k, x in zip(found["keys"].to_pylist(), found["n"].to_pylist(), strict=True))])


def priced_batches(corpus: DataFrame, order: int = ORDER, least: int = MIN_COUNT) -> DataFrame:
    """(batch, kind, bucket, keys, value) for the packed grams of each batch: value holds their float32 costs."""
    low = min(order, LOW)
    top = short_counts(corpus, order)
    shared = [merged([(top[0] & _mask(k + 1), top[1])]) for k in range(low)]

    def run(table: pa.Table) -> pa.Table:
        packs = table["keys"].to_pylist()
        each = [unpacked(k) for k in packs]
        keys, n = merged([(k, unpacked(x)) for k, x in zip(each, table["n"].to_pylist(), strict=True)])
        now, levels = (keys[n > 0], n[n > 0]), []
        for k in range(order, low - 1, -1):
            now = merged([(now[0] & _mask(k + 1), now[1])])
            levels.append(now)
        cost = prices(shared + levels[::-1], keys, least).astype(np.float32)
        values = [cost[np.searchsorted(keys, k)].tobytes() for k in each]
        return pa.table({"batch": table["batch"], "kind": pa.array([1] * len(each), pa.int8()), "bucket": table["bucket"], "keys": pa.array(packs, pa.binary()), "value": pa.array(values, pa.binary())})

    return corpus.where("kind = 1").select("batch", "bucket", "keys", "n").groupBy("bucket").applyInArrow(run, VALUES)


def priced(corpus: DataFrame, order: int = ORDER, least: int = MIN_COUNT) -> DataFrame:
    """(key, cost) for each distinct gram of read_corpus()."""

    def run(batches):
        for b in batches:
            for k, x in zip(b["keys"].to_pylist(), b["value"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(k)), pa.array(np.frombuffer(x, np.float32))], ["key", "cost"])

    return priced_batches(corpus, order, least).mapInArrow(run, "key long, cost float").distinct()


def counted_words(corpus: DataFrame) -> DataFrame:
    """Staged (batch, kind, bucket, keys, value, total, distinct) for the packed words of each batch: value holds their packed
    counts in all training texts; total and distinct are the bucket's, in one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        packs = table["keys"].to_pylist()
        each = [unpacked(k) for k in packs]
        keys, n = merged([(k, unpacked(x)) for k, x in zip(each, table["n"].to_pylist(), strict=True)])
        values = [packed(n[np.searchsorted(keys, k)]) for k in each]
        sums = {c: pa.array([x, *[0] * (len(each) - 1)], pa.int64()) for c, x in (("total", int(n.sum())), ("distinct", int(np.count_nonzero(n))))}
        return pa.table({"batch": table["batch"], "kind": pa.array([0] * len(each), pa.int8()), "bucket": table["bucket"], "keys": pa.array(packs, pa.binary()), "value": pa.array(values, pa.binary()), **sums})

    words = corpus.where("kind = 0").select("batch", "bucket", "keys", "n").groupBy("bucket").applyInArrow(run, VALUES + ", total long, distinct long")
    with arrow_rows(corpus.sparkSession, PACKED_ROWS):
        return stage(words, "ppm-words")


def score_documents(docs: DataFrame, folds: int = 10, order: int = ORDER) -> DataFrame:
    """Scores every row of docs (doc_id, text), learning from those whose crc32(doc_id as text) mod folds is not 0.

    held_out; n_tokens and n_known (tokens of the text with its end; those seen in training); train_tokens; base_score
    (add-0.1 unigram over tokens) and score (PPM), both log10. Null texts are empty: their end alone is scored. A null
    doc_id counts as held out. Repeated rows are scored, and learnt from, one by one. With no training row only escapes
    are left (V = N = 0). Other columns are left out. Runs at once: the scores are staged."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out"))
    corpus = read_corpus(docs, order)
    words = counted_words(corpus)
    size = words.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"] or 0
    floor = math.log10(total + 0.1 * (distinct + 1)) if total or distinct else math.log10(0.1)

    def together(parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and their values; parts are given up as they are read."""
        keys, values = [list(x) for x in zip(*parts, strict=True)]
        parts.clear()
        keys = np.concatenate(keys)
        sort = np.argsort(keys)
        keys = keys[sort]
        return keys, np.concatenate(values)[sort]

    def run(batches):
        now, words_, parts, known, logs, counts = None, [], [], None, None, None
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k] for c in ("batch", "kind", "bucket", "keys", "value", "doc_id", "held_out", "sizes", "texts")}
                kind = row["kind"].as_py()
                if row["batch"].as_py() != now:
                    now, words_, parts, known = row["batch"].as_py(), [], [[] for _ in range(PARTS)], None
                if kind < 2:
                    value = row["value"].as_py()
                    into = parts[row["bucket"].as_py() % PARTS] if kind else words_
                    into.append((unpacked(row["keys"].as_py()), np.frombuffer(value, np.float32) if kind else unpacked(value)))
                    continue
                if known is None:
                    known, counts = together(words_)
                    logs, counts = np.log10(counts + 0.1) - floor, counts > 0
                    for part, x in enumerate(parts):
                        parts[part] = together(x) if x else None
                sizes = row["sizes"].as_py()
                ends, text = np.cumsum([0, *sizes]).tolist(), unzip.decompress(row["texts"].as_py())
                texts = [text[x:y] for x, y in zip(ends, ends[1:], strict=False)]
                n = len(texts)
                hashes, each = word_hashes(texts)
                place = np.searchsorted(known, np.concatenate([hashes.view(np.int64), np.full(n, END_WORD, np.int64)]))
                doc = np.concatenate([np.repeat(np.arange(n), each), np.arange(n)])
                base, hit = np.bincount(doc, logs[place], n), np.bincount(doc, counts[place], n)
                some, back = np.unique(grams(texts, order), return_inverse=True)
                begin = np.concatenate([[0], np.cumsum([x + 1 for x in sizes])])[:-1]
                cost, part_of = np.zeros(len(some)), _dealt(some, PARTS, order)
                for part in np.unique(part_of).tolist():
                    own = np.flatnonzero(part_of == part)
                    seen, costs = parts[part]
                    cost[own] = costs[np.searchsorted(seen, some[own])]
                score = np.add.reduceat(cost[back], begin)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"].as_py(), pa.int64()), pa.array(row["held_out"].as_py(), pa.bool_()), pa.array(each.astype(np.int64) + 1), pa.array(hit.astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    none = lambda c, t: F.lit(None).cast(t).alias(c)
    own = [("doc_id", "array<long>"), ("held_out", "array<boolean>"), ("sizes", "array<long>"), ("texts", "binary")]
    texts = corpus.where("kind = 2").select("batch", "kind", none("bucket", "long"), none("keys", "binary"), none("value", "binary"), *[c for c, _ in own])
    known = words.select("batch", "kind", "bucket", "keys", "value").union(priced_batches(corpus, order).select("batch", "kind", "bucket", "keys", "value"))
    known = known.select("*", *[none(c, t) for c, t in own])
    # A batch is scored in one task: what is known of its words and grams comes first, then its texts, one slice at a time.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = known.union(texts).repartition(parts, "batch").sortWithinPartitions("batch", "kind")
    with arrow_rows(docs.sparkSession, PACKED_ROWS):
        scored = stage(dealt.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "ppm-scores")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
