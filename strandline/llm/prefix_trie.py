"""Conversation prefix trie: range-sorted turn arrays, adjacent common prefixes, a stack sweep, stitched open stacks.

A turn is a token of TOKEN bytes: 16 of a digest of (role, text) and the code points of its text. A conversation is the row of
its tokens, one binary key, so that texts are never sorted, joined or gathered.
1. Keys are range-sorted by (key, conv_id) over the whole table; copies of one conversation, however many, are divided by
   conv_id.
2. sweep(): in each partition the common prefix of neighbours moves a stack of open nodes. A node that closes away from the
   partition's edges is whole. The nodes of a partition's first key may have begun before it, those of its last key may go
   on after it: they leave as two paths of partial sums.
3. stitch(): a stack sweep over these paths, one row for each partition, in order. What it reads grows with the number of
   partitions and the depth of their edge conversations, not with the rows.
4. A node learns its parent's smallest member when the parent closes. Only children of stitched nodes, and those of nodes
   with more than KIDS children, look it up by a join with those few parents.
5. The digest of the members that end at a node is taken while their run passes. Runs at a partition's edge and runs of more
   than RUN ids leave as lists, and are hashed by node, list after list.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stage

TOKEN, DIGEST, HEAD, BASE = 20, 16, 5, 100
#: Children that a node holds back until its smallest member is known; ids of a run that are held until its end is seen.
KIDS, RUN = 4096, 65536
#: Rows of the lookup table of parents up to which it is broadcast (some 40 bytes each).
BROADCAST = 200_000
_FIELDS = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
SWEPT = f"kind int, part int, seq long, {_FIELDS}, path binary, ids array<long>"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), *[(x, pa.int64()) for x in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.binary()), ("path", pa.binary()), ("ids", pa.list_(pa.int64()))])
_NAMES = _ARROW.names
#: One open node of a path: its id, smallest member (a flag before it: any), and sums; a digest of its ends where it is known.
_OPEN = "<16s?qqqqqI?32s"
NODE, LIST, PATHS = 0, 1, 2


def turn_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id, key, n_turns) of conversations(conv_id, turn, role, text): turns by turn, nulls first, ties by role and text.

    Null roles and texts are empty, rows without conv_id belong to no conversation. Texts are shuffled for tied turns alone."""
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    token = F.concat(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.hex(F.length("text")), 8, "0")).alias("token")
    tied = stage(t.groupBy("conv_id", "turn").count().where("count > 1").select("conv_id", F.col("turn").alias("t")), "trie-ties")
    if tied.isEmpty():
        placed = t.select("conv_id", "turn", F.lit(0).alias("k"), token)
    else:
        on = (t["conv_id"] == tied["conv_id"]) & t["turn"].eqNullSafe(tied["t"])
        order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
        placed = t.join(tied, on, "left_anti").select("conv_id", "turn", F.lit(0).alias("k"), token).union(t.join(tied, on, "left_semi").select("conv_id", "turn", F.row_number().over(order).alias("k"), token))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k", "token"))).alias("a"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("a", lambda x: x["token"]), "")).alias("key"), F.size("a").cast("long").alias("n_turns"))


def shared_openings(turns: DataFrame) -> DataFrame:
    """(conv_id, key): the first h turns of conversation c - c % 100 before c's own turns after its first h; h = crc32(c) % 6."""
    own = turn_tokens(turns)
    heads = turn_tokens(turns.where(f"conv_id % {BASE} = 0")).select(F.col("conv_id").alias("base"), F.substring("key", 1, HEAD * TOKEN).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int") * TOKEN
    both = own.join(heads, own["conv_id"] - own["conv_id"] % BASE == heads["base"], "left").withColumn("h", h)
    return both.select("conv_id", F.expr("concat(substring(coalesce(head, X''), 1, h), substring(key, h + 1))").alias("key"))


class _Node:
    __slots__ = ("n", "low", "children", "leaves", "saved", "weight", "kids", "id", "sha", "run", "listed", "edge")

    def __init__(self, weight: int, edge: bool):
        self.n, self.low, self.children, self.leaves, self.saved, self.weight = 0, None, 0, 0, 0, weight
        self.kids, self.id, self.sha, self.run, self.listed, self.edge = [], None, None, None, False, edge


def _common(a: bytes, b: bytes) -> int:
    """Leading equal tokens of two keys."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TOKEN
    if n <= 64 * TOKEN:
        k = 0
        while a[k : k + TOKEN] == b[k : k + TOKEN]:
            k += TOKEN
        return k // TOKEN
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // TOKEN


def _ids_of(key: bytes, lowest: int, highest: int) -> list[bytes]:
    """The ids of the nodes at depths lowest..highest of a key: digests of its prefixes."""
    h, out = hashlib.sha256(key[: lowest * TOKEN]), []
    for d in range(lowest, highest + 1):
        out.append(h.copy().digest()[:DIGEST])
        h.update(key[d * TOKEN : (d + 1) * TOKEN])
    return out


class _Out:
    """Rows gathered to Arrow batches; lists of ids count by their lengths."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += 1 + len(row.get("ids") or ()) + len(row.get("path") or ()) // 64

    def batch(self, least: int = 8192):
        if self.rows and self.size >= least:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in self.rows], t) for k, t in zip(_NAMES, _ARROW.types, strict=True)], schema=_ARROW)
            self.rows, self.size = [], 0
            return [made]
        return []


def _joined(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def sweep(kids: int = KIDS, run: int = RUN):
    """The function of a range-sorted partition's batches (conv_id, key): nodes, lists of ends, and the two open paths."""

    def sweep_partition(batches):
        from pyspark import TaskContext

        part, out, seq = TaskContext.get().partitionId(), _Out(), 0
        stack: list[_Node] = []
        first_key = key = None
        popped: dict[int, bytes] = {}  # depth -> packed open node of the first key that closed within the partition

        def node_id(d: int) -> bytes:
            if stack[d].id is None:
                stack[d].id = _ids_of(key, d, d)[0]
            return stack[d].id

        def to_list(d: int) -> None:
            nonlocal seq
            x = stack[d]
            x.listed = True
            for k in range(0, len(x.run), 8192):
                seq += 1
                out.add(kind=LIST, part=part, seq=seq, node=node_id(d), ids=x.run[k : k + 8192])
            x.run = []

        def end_run(d: int) -> None:
            """The run of members that end at the stack's top is over."""
            x = stack[d]
            if x.run is not None and not x.listed:
                x.sha = hashlib.sha256(_joined(x.run)).digest()
                x.run = None
            elif x.run:
                to_list(d)

        def flush(d: int) -> None:
            """Children of a node whose smallest member is not known yet: they look it up."""
            name = node_id(d)
            for row in stack[d].kids:
                out.add(**row, parent=name)
            stack[d].kids = []

        def packed(d: int) -> bytes:
            flush(d)
            x = stack[d]
            return struct.pack(_OPEN, node_id(d), x.low is not None, x.low or 0, x.n, x.children, x.leaves, x.saved, x.weight, x.sha is not None, x.sha or b"")

        def close(d: int) -> None:
            x = stack[d]
            end_run(d)
            if x.edge:
                popped[d] = packed(d)
                stack.pop()
                return
            up, leaves, saved = stack[d - 1], x.leaves or 1, x.saved + (x.n - 1) * x.weight
            wide = x.id is not None
            for row in x.kids:
                out.add(**row, parent_conv_id=x.low)
            ends = None if x.listed else x.sha or _NO_ENDS
            up.kids.append(dict(kind=NODE, node=x.id if wide or x.listed else None, depth=d, conv_id=x.low, n_convs=x.n, n_children=x.children, n_leaves=leaves, saved_tokens=saved, ends=ends))
            stack.pop()
            up.n, up.children, up.leaves, up.saved, up.low = up.n + x.n, up.children + 1, up.leaves + leaves, up.saved + saved, x.low if up.low is None else min(up.low, x.low)
            if len(up.kids) >= kids:
                flush(d - 1)

        for b in batches:
            for conv, now in zip(b["conv_id"].to_pylist(), b["key"].to_pylist(), strict=True):
                depth = len(now) // TOKEN
                if key is None:
                    first_key, same = now, -1
                    fresh = range(depth + 1)
                else:
                    same = _common(key, now)
                    if same < len(key) // TOKEN or depth > same:
                        end_run(len(stack) - 1)
                    while len(stack) - 1 > same:
                        close(len(stack) - 1)
                    fresh = range(same + 1, depth + 1)
                edge = key is None
                key = now
                for d in fresh:
                    stack.append(_Node(int.from_bytes(now[d * TOKEN - 4 : d * TOKEN], "big") if d else 0, edge))
                if edge:
                    for x, name in zip(stack, _ids_of(now, 0, depth), strict=True):
                        x.id = name
                x = stack[-1]
                if x.run is None:
                    x.run, x.listed = [], x.edge
                x.n += 1
                x.low = conv if x.low is None else min(x.low, conv)
                x.run.append(conv)
                if len(x.run) >= run:
                    to_list(depth)
            yield from out.batch()
        if key is None:
            return
        top = len(stack) - 1
        if stack[top].run is not None:
            to_list(top)  # it may go on in the next partition
        kept = sum(x.edge for x in stack) - 1
        for x, name in zip(stack, _ids_of(key, 0, top), strict=True):
            x.id = name
        first = b"".join([packed(d) for d in range(kept + 1)] + [popped[d] for d in range(kept + 1, len(first_key) // TOKEN + 1)])
        last = b"".join(packed(d) for d in range(kept + 1, top + 1))
        out.add(kind=PATHS, part=part, seq=kept, path=struct.pack("<q", len(first)) + first + last)
        yield from out.batch(0)

    return sweep_partition


_NO_ENDS = hashlib.sha256(b"").digest()


def stitch(batches):
    """The open paths of all partitions, in order: nodes with whole sums. Their parents' ids stand for the smallest members."""
    out = _Out()
    stack: list[list] = []  # [id, low, n, children, leaves, saved, weight, ends]

    def load(raw: bytes) -> list[list]:
        return [[i, low if any_ else None, n, children, leaves, saved, weight, ends if known else None] for i, any_, low, n, children, leaves, saved, weight, known, ends in struct.iter_unpack(_OPEN, raw)]

    def merge(x: list, y: list) -> None:
        x[1] = y[1] if x[1] is None else x[1] if y[1] is None else min(x[1], y[1])
        for k in (2, 3, 4, 5):
            x[k] += y[k]
        x[7] = x[7] or y[7]

    def close() -> None:
        i, low, n, children, leaves, saved, weight, ends = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * weight
        out.add(kind=NODE, node=i, parent=stack[-1][0] if stack else None, depth=len(stack), conv_id=low, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends=ends)
        if stack:
            merge(stack[-1], [None, low, n, 1, leaves, saved, 0, None])

    for b in batches:
        for kept, raw in zip(b["seq"].to_pylist(), b["path"].to_pylist(), strict=True):
            cut = 8 + struct.unpack_from("<q", raw)[0]
            first, last = load(raw[8:cut]), load(raw[cut:])
            same = 0
            while same < min(len(stack), len(first)) and stack[same][0] == first[same][0]:
                same += 1
            while len(stack) > same:
                close()
            for k, x in enumerate(first):
                if k < same:
                    merge(stack[k], x)
                else:
                    stack.append(x)
            while len(stack) > kept + 1:
                close()
            stack.extend(last)
            yield from out.batch()
    while stack:
        close()
    yield from out.batch(0)


def hash_lists(batches):
    """(node, ends): digests of the ids of lists that come by node, part and seq."""
    made = pa.schema([("node", pa.binary()), ("ends", pa.binary())])
    node, h, empty = None, None, True
    for b in batches:
        rows = []
        for name, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    rows.append((node, h.digest()))
                node, h, empty = name, hashlib.sha256(), True
            h.update(b"" if empty or not ids else b",")
            h.update(_joined(ids))
            empty = empty and not ids
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], schema=made)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.digest()], pa.binary())], schema=made)


def prefix_trie(keys: DataFrame, kids: int = KIDS, run: int = RUN) -> DataFrame:
    """The nodes of the trie of keys(conv_id, key), a key being tokens of TOKEN bytes whose last four are the turn's length.

    Every distinct prefix is a node, from the root (depth 0) on; an empty or null key is a member of the root alone; repeated
    rows are members each; rows without conv_id are left out; an empty table has no node."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(keys.where("conv_id IS NOT NULL").select("conv_id", F.coalesce("key", F.lit(b"")).alias("key")), "trie-keys")
    swept = stage(rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(sweep(kids, run), SWEPT), "trie-swept")
    paths = swept.where(F.col("kind") == PATHS).select("part", "seq", "path").repartition(1).sortWithinPartitions("part")
    stitched = stage(paths.mapInArrow(stitch, SWEPT), "trie-stitched")
    fields = [x.split()[0] for x in _FIELDS.split(", ")]
    nodes = swept.where(F.col("kind") == NODE).select(*fields).union(stitched.select(*fields))
    whole = nodes.where("parent IS NULL AND ends IS NOT NULL")
    parents = nodes.where("node IS NOT NULL").select(F.col("node").alias("p"), F.col("conv_id").alias("of_parent"))
    lists = swept.where(F.col("kind") == LIST).select("node", "part", "seq", "ids")
    hashed = lists.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(hash_lists, "node binary, ends binary")
    hashed = hashed.select(F.col("node").alias("e"), F.col("ends").alias("listed"))
    if parents.count() <= BROADCAST:
        parents, hashed = F.broadcast(parents), F.broadcast(hashed)  # a listed node is a row of parents, too
    rest = nodes.where("parent IS NOT NULL OR ends IS NULL").join(parents, F.col("parent") == F.col("p"), "left").join(hashed, F.col("node") == F.col("e"), "left")
    named = {"parent_conv_id": F.coalesce("parent_conv_id", "of_parent"), "ends": F.coalesce("listed", "ends", F.lit(_NO_ENDS))}
    out = whole.union(rest.select(*[named.get(x, F.col(x)).alias(x) for x in fields]))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))


def trie_query(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: the contract of op12. Columns other than conv_id, turn, role, text are left out."""
    return prefix_trie(shared_openings(conversations.select("conv_id", "turn", "role", "text")))
