"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes the set of hashes of its distinct word shingles; equal sets are one node from here on, so copies
   never meet as pairs. The set is cut into BINS ranges of the hash space; the least hash of each range is its signature
   and an empty range borrows the value of a range that a fixed hash sequence of (range, attempt) names, the same for
   every set (optimal densification: two signatures agree in a range with probability equal to their Jaccard similarity).
2. BANDS buckets of ROWS ranges each. Two sets of similarity 0.75 miss all of 40 buckets of 5 with probability 2e-5.
3. A bucket sends an edge from its least node to each other one: as many candidates as members, whatever its size.
4. Candidates are confirmed on full shingle sets, rebuilt from whole texts; a center's text is sent once for each
   STREAM members, not once for each of them.
5. Components of confirmed edges. A member that was a center has met all of its bucket. Where the others of a bucket are
   in more than one component, as in a family that shares a passage, they are open: pairs among them are not yet known.
6. Open sets are dealt anew by their rarest shingles (rare(): a pair of similarity percent / 100 shares one, whatever the
   order, so nothing is lost), and star edges are taken from CENTERS centers of each such group, those first that have the
   least of their own: what a family was copied from comes before its copies. A passage that makes the family is common and
   is nobody's rare shingle. Pairs whose bitmaps rule the similarity out make no row (_may_link). GROWTH times as many centers as before are taken and steps 4 and 5 repeat until no group is
   left: every two members of a group are then in one component, or compared, or of sizes that rule the similarity out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bloom, bloom_columns, bloom_has, mix64, sliced, stage, text_bytes, worker_state
from strandline.llm.components import components

BANDS, ROWS, CENTERS, GROWTH, STREAM = 40, 5, 8, 4, 256
BINS = BANDS * ROWS
BITS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


#: Bytes hashed at once: their arrays stay in a core's cache.
_SPAN = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^k and its inverse^k mod 2^64 for k < n; those of a usual span are kept in the worker."""

    def fresh(n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            up[0] = down[0] = 1
            return np.multiply.accumulate(up), np.multiply.accumulate(down)

    if n > 2 * _SPAN:
        return fresh(n)
    up, down = worker_state().setdefault("powers", None) or fresh(2 * _SPAN)
    worker_state()["powers"] = up, down
    return up[:n], down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, cut at ASCII white space) in order, and how many each text has."""
    hashes, counts, held, size = [], [], [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= _SPAN:
            for to, x in zip((hashes, counts), _span_hashes(held), strict=True):
                to.append(x)
            held, size = [], 0
    if held:
        for to, x in zip((hashes, counts), _span_hashes(held), strict=True):
            to.append(x)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _span_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(joined) + 1)
    run = np.zeros(len(joined) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=run[1:])
        hashes = mix64((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
    last = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(begin, last)]))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words: the whole sequence as one; no words: empty."""
    out, at = [], 0
    chunk: list[bytes] = []
    size = 0
    sets: list[np.ndarray] = []
    for t in [*texts, None]:
        if t is not None:
            chunk.append(t)
            size += len(t)
            if size < _SPAN:
                continue
        if not chunk:
            break
        hashes, counts = word_hashes(chunk)
        with np.errstate(over="ignore"):
            full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
            for k in range(words):
                full = mix64(full * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(full)])
            at = 0
            for n in counts.tolist():
                if n >= words:
                    sets.append(np.unique(full[at : at + n - words + 1]))
                elif n:
                    one = np.uint64(n)
                    for h in hashes[at : at + n]:
                        one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + h)
                    sets.append(np.array([one], np.uint64))
                else:
                    sets.append(np.zeros(0, np.uint64))
                at += n
        chunk, size = [], 0
    out.extend(sets)
    return out


def set_digest(s: np.ndarray) -> int:
    """The node of a set: signed 64 bits."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([np.sum(mix64(s), dtype=np.uint64) + mix64(np.array([len(s)], np.uint64))[0]]))
    return int(h.view(np.int64)[0])


_EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)
_ATTEMPTS = 1024  # a set of one range alone misses all of them once in 170 times, and then takes its least hash


def _borrow_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        k = np.arange(_ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
        return (mix64(k + np.uint64(77)) % np.uint64(BINS)).astype(np.uint8)


_BORROW = _borrow_table()


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation minima of a non-empty sorted set, densified."""
    at = np.searchsorted(s, _EDGES)
    upto = np.append(at[1:], len(s))
    held = upto > at
    out = np.zeros(BINS, np.uint64)
    out[held] = s[at[held]]
    empty = np.flatnonzero(~held)
    step = 0
    while len(empty) and step < _ATTEMPTS:
        block = _BORROW[step : step + 32][:, empty]
        hit = held[block]
        first = hit.argmax(0)
        found = hit[first, np.arange(len(empty))]
        out[empty[found]] = out[block[first[found], np.flatnonzero(found)]]
        empty, step = empty[~found], step + 32
    if len(empty):
        out[empty] = s[0]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sig, key = signature(s).reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix64(key * np.uint64(0xA24BAED4963EE407) + sig[:, k])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _profiles(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches):
            node, n, keys = [], [], []
            for s in shingle_sets(text_bytes(b["text"])):
                node.append(set_digest(s) if len(s) else None)
                n.append(len(s))
                keys.append(bands(s) if len(s) > 1 else [])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "keys"])

    return stage(docs.mapInArrow(run, "doc_id long, n_shingles long, node long, keys array<long>"), "oph-docs")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for each wanted node, from the document that stands for it."""
    words = bloom(wanted.join(nodes, "node"), "doc_id")

    def run(batches):
        for b in sliced(batches):
            b = b.filter(pa.array(bloom_has(words, b)))
            texts = text_bytes(b["text"])
            nodes_ = [set_digest(s) if len(s) else None for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array(texts, pa.binary())], ["node", "text"])

    found = docs.select("text", *bloom_columns("doc_id")).mapInArrow(run, "node long, text binary")
    return found.join(wanted, "node").dropDuplicates(["node"])


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITS bits of a set, each flipped by every shingle that falls on it: where the bitmaps of two sets differ in d bits, the sets
    differ in d shingles at least."""
    with np.errstate(over="ignore"):
        odd = np.bincount((mix64(s + np.uint64(0x9E3779B9)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(percent: int, column: str = "bits", other: str = "c_bits"):
    """False only of pairs whose bitmaps differ in more bits than sets of these sizes and that similarity do in shingles.

    Sets of sizes a and b with intersection i differ in a + b - 2i shingles; linked ones have (100 + percent) i >= percent (a + b)."""
    differ = sum((F.bit_count(F.col(f"{column}{k}").bitwiseXOR(F.col(f"{other}{k}"))) for k in range(BITS // 64)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("c_size"))


def rare(texts: DataFrame, percent: int) -> DataFrame:
    """(key, node, size, own, few, bits0, bits1, ...) for each rarest shingle (key) of each of texts (node, text); own: the share of
    the set's shingles that no other text has; bits: the words of its bitmap.

    Shingles are ordered by the number of these texts that hold them, then by hash. Two sets of similarity percent / 100
    share one of the first size * (1 - percent / 100) + 1 shingles of each; of sets as large as their partner or smaller
    size * (100 - percent) / (100 + percent) + 1 do, which few marks. Shingles of one text only count but give no row."""

    def run(batches):
        for b in sliced(batches):
            sets = shingle_sets(text_bytes(b["text"]))
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], ["node", "size", "keys", "bits"])

    sets = stage(texts.mapInArrow(run, "node long, size long, keys array<long>, bits array<long>"), "oph-sets")
    held = sets.select("node", "size", F.explode("keys").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    order = held.join(common, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))
    alone = F.col("size") - F.size("order")
    reach = lambda share: (F.floor(F.col("size") * share + 1e-9) + 1 - alone).cast("int")
    least, most = reach((100 - percent) / (100 + percent)), reach((100 - percent) / 100)
    first = order.where(most > 0).select("node", "size", (alone / F.col("size")).alias("own"), least.alias("least"), F.posexplode(F.slice("order", 1, F.greatest(most, F.lit(1)))))
    return first.join(sets.select("node", "bits"), "node").select(F.col("col.key").alias("key"), "node", "size", "own", (F.col("pos") < F.col("least")).alias("few"), *[F.col("bits")[k].alias(f"bits{k}") for k in range(BITS // 64)])


def _confirmed(texts: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) with 100 * intersection >= percent * union; texts (node, text) has every node."""
    spread = edges.groupBy("a").agg(F.ceil(F.count("*") / STREAM).alias("parts"))
    edges = edges.join(spread, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    centers = edges.select("a", "part").distinct().join(texts, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = edges.join(texts, F.col("b") == F.col("node")).select("a", "part", "b", "text")

    def run(batches):
        now, center = None, None
        for b in sliced(batches):
            a_out, b_out = [], []
            sets = shingle_sets(text_bytes(b["text"]))
            for a, part, other, s in zip(b["a"].to_pylist(), b["part"].to_pylist(), b["b"].to_pylist(), sets, strict=True):
                if other is None:
                    now, center = (a, part), s
                    continue
                if (a, part) != now:
                    raise ValueError("a center's text is missing")
                both = overlap(center, s)
                if 100 * both >= percent * (len(center) + len(s) - both):
                    a_out.append(a)
                    b_out.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    rows = centers.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return stage(rows.mapInArrow(run, "a long, b long"), "oph-edges")


def _grown(tree: DataFrame, links: DataFrame) -> DataFrame:
    """tree (node, component) with further links (a, b): only the components that these touch are worked on."""
    of = lambda c: tree.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    more = stage(components(between), "oph-tree")
    moved = tree.join(more.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return stage(moved.union(more.join(tree.select("node"), "node", "left_anti").select("node", "component")), "oph-tree")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their five-word shingles; component_id is the smallest
    doc_id reachable; kept: doc_id = component_id. Null or wordless texts have no shingles and no links. A null doc_id is
    a row like others but never the smallest; where all of a component are null, component_id is null and kept false. Of
    repeated ids all rows keep or go alike. An empty table gives no row; other columns are left out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _profiles(docs)
    nodes = stage(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"), F.any_value("n_shingles").alias("size")), "oph-nodes")
    ids = nodes.select("node", "doc_id")
    keyed = nodes.where(F.size("keys") > 0).select("node", "size", F.explode("keys").alias("key"))
    # A bucket's center is its least node.
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("least"), F.max("node").alias("most")).where("least.node != most")
    shared = shared.select("key", F.col("least.node").alias("center"), F.col("least.size").alias("c_size"))
    members = stage(keyed.join(shared, "key").where("node != center").select("key", "node", "size", "center", "c_size"), "oph-members")
    alike = 100 * F.least("size", "c_size") >= percent * F.greatest("size", "c_size")
    edges = stage(members.where(alike).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "oph-pairs")
    tree = None
    if not edges.isEmpty():
        wanted = stage(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "oph-wanted")
        tested = edges
        tree = stage(components(_confirmed(stage(_texts(docs, ids, wanted), "oph-texts"), edges, percent)), "oph-tree")
        named = members.join(tree, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        several = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("key")
        wanted = stage(named.join(several, "key", "left_semi").select("node").distinct(), "oph-wanted")
        texts = stage(_texts(docs, ids, wanted), "oph-texts")
        open_, most = rare(texts, percent), CENTERS
        # Of two sets the larger one is met in its longer list of rare shingles, the smaller one in its shorter list.
        meets = F.when(F.col("size") < F.col("c_size"), F.col("few")).when(F.col("size") > F.col("c_size"), F.col("c_few")).otherwise(F.col("few") & F.col("c_few"))
        words = [f"bits{k}" for k in range(BITS // 64)]
        while True:
            open_ = open_.select("key", "node", "size", "own", "few", *words).join(tree, "node", "left").withColumn("component", F.coalesce("component", "node"))
            several = open_.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("key")
            left = open_.join(several, "key", "left_semi")
            turn = F.row_number().over(Window.partitionBy("key").orderBy("own", "node"))
            open_ = stage(left.select("key", "node", "size", "own", "few", *words, "component", (turn <= most).alias("center")), "oph-members")
            if open_.isEmpty():
                break
            centers = open_.where("center").select("key", F.col("node").alias("c_node"), F.col("size").alias("c_size"), F.col("few").alias("c_few"), F.col("component").alias("c_component"), *[F.col(w).alias(f"c_{w}") for w in words])
            pairs = open_.join(centers, "key").where(alike & meets & (F.col("component") != F.col("c_component")) & _may_link(percent))
            edges = pairs.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
            edges = stage(edges, "oph-pairs")
            open_, most = open_.where("NOT center"), most * GROWTH
            if not edges.isEmpty():
                tested, tree = tested.union(edges), _grown(tree, _confirmed(texts, edges, percent))
    if tree is None:
        best = ids.select("node", F.col("doc_id").alias("component_id"))
    else:
        low = ids.join(tree, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        linked = tree.join(low, "component").select("node", "component_id")
        best = ids.join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(best, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
