"""Scaled sketches and the prefix trie against brute-force versions."""

import hashlib
import random
import re
import zlib

import pytest

from tests.llm.helpers import corpus, documents

NO_ENDS = hashlib.sha256(b"").hexdigest()


def sketch(text, limit="2" + "0" * 11):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    runs = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []
    return sorted({h for h in (hashlib.md5(x.encode()).hexdigest()[:12] for x in runs) if h < limit})


def jaccard(a, b, same):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else float(same)


def brute_fingerprints(rows):
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        mark = lambda x: hashlib.md5(x.encode()).hexdigest() + ":" + "".join(sketch(x))
        held = lambda a, b, same: len({*a} & {*b}) / len(a) if a else float(same)
        a, b, c = sketch(t), sketch(e), sketch(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), jaccard(a, b, t == e), jaccard(a, c, t == after), held(a, b, t == e), held(a, c, t == after)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_equal_brute_force(spark, parts):
    """Ranges of many rows, of one and of none; heavy ids; null ids and texts; cuts in words and white space; repeated rows."""
    from strandline.llm.sketch_scaled import fingerprint_edits

    rng = random.Random(parts)
    rows = [(r[0], r[1]) for r in corpus(seed=4, n=40)]
    rows += [(rng.choice([7, None]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for _ in range(60)] + [(None, None), (7, "x"), (7, "x"), (7, "x")]
    rows += [(1000 + k, "".join(rng.choice(["a", "bé", " ", "\n ", "\t", "cc", "　"]) for _ in range(rng.randint(0, 40)))) for k in range(80)]
    df = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = sorted((tuple(r) for r in fingerprint_edits(df, parts=parts).collect()), key=repr)
    assert got == brute_fingerprints(rows)


def test_fingerprints_of_little(spark):
    from strandline.llm.sketch_scaled import fingerprint_edits, sketch_of

    assert fingerprint_edits(documents(spark, [])).count() == 0
    one = fingerprint_edits(documents(spark, [(5, "a b c d e f g h", "en", "s")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 15
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="fraction"):
        sketch_of(F.array(F.lit("a")), 0)


def test_merged_sketches_are_those_of_all_texts(spark):
    """Of a group with most rows, too; containment between very unequal texts is found within its error."""
    from pyspark.sql import functions as F

    from strandline.llm.sketch_scaled import containment, merge_sketches, sketches

    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long = words(20000)
    part = long[5000:5600]
    rows = [(0, " ".join(long), "big"), (1, " ".join(part), "small"), (2, " ".join(part + words(600)), "half"), (3, "", "none")] + [(4 + k, " ".join(words(30)), "big") for k in range(50)]
    df = sketches(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    merged = {r["source"]: r["sketch"] for r in merge_sketches(df, "source").collect()}
    for s, found in merged.items():
        assert found == sorted({h for _, t, x in rows if x == s for h in sketch(t)})
    pair = df.where("doc_id IN (1, 2)").select("doc_id", F.col("sketch").alias("a")).crossJoin(df.where("doc_id = 0").select(F.col("sketch").alias("b")))
    held = {r["doc_id"]: r["x"] for r in pair.select("doc_id", containment(F.col("a"), F.col("b"), F.lit(False)).alias("x")).collect()}
    assert held[1] == 1.0 and abs(held[2] - 0.5) < 0.15
    assert not re.search("Python|Arrow|Pandas", merge_sketches(df, "source")._jdf.queryExecution().toString())


def test_fingerprints_run_no_python(spark):
    from strandline.llm.sketch_scaled import fingerprint_edits

    assert not re.search("Python|Arrow|Pandas", fingerprint_edits(documents(spark, corpus()))._jdf.queryExecution().toString())


def brute_trie(rebuilt):
    """rebuilt: (conv_id, tuple of (role, text)) rows."""
    nodes = {}
    for c, a in rebuilt:
        for d in range(len(a) + 1):
            nodes.setdefault(a[:d], []).append((c, len(a) == d))
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = sorted(c for c, end in members if end)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        out.append((min(c for c, _ in members), len(k), min(c for c, _ in nodes[k[:-1]]) if k else None, len(members), sum(len(x) == len(k) + 1 for x in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple((r, t) for _, _, r, t in sorted(a)) for c, a in own.items()}
    out = []
    for c, a in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c - int(c / 100) * 100)
        out.append((c, own.get(base, ())[:h] + a[h:]))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_trie_of_conversations_equals_brute_force(spark, partitions):
    from strandline.llm.prefix_trie import trie_query

    rng = random.Random(partitions)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "\U0001f600x", None])) for c in [*range(60), *range(190, 215), -3, -150, 10**12 + 7] for k in range(rng.randint(1, 9))]
    rows += [(100, None, None, None), (100, None, "user", "z"), (100, 0, "user", "y"), (0, 0, "user", "y"), (0, 0, "user", "y"), (None, 0, "user", "lost")] + [(300, k, "user", "long") for k in range(150)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, node int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = sorted((tuple(r) for r in trie_query(df).collect()), key=repr)
        assert trie_query(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_trie(brute_rebuilt(rows))


@pytest.mark.parametrize("kids,run", [(2, 2), (3, 10**6), (10**6, 3)])
def test_trie_of_keys_with_hot_prefixes(spark, kids, run):
    """A third of all rows are one conversation, another third share their first turns; small bounds force lists and lookups;
    deep paths cross partitions."""
    from strandline.llm.prefix_trie import TOKEN, prefix_trie

    rng = random.Random(kids)
    turn = lambda x: hashlib.sha256(x.encode()).digest()[: TOKEN - 4] + len(x).to_bytes(4, "big")
    hot = tuple("hot" * (k + 1) for k in range(90))
    seqs = [hot[:7]] * 40 + [hot[: rng.randint(0, 90)] for _ in range(20)] + [hot[:5] + (f"x{k}",) for k in range(30)] + [tuple(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(30)]
    rows = [(rng.randrange(-50, 1000), s) for s in seqs] + [(1, ()), (1, ())]
    keys = spark.createDataFrame([(c, bytearray(b"".join(map(turn, s))) if s else None) for c, s in rows] + [(None, bytearray(b""))], "conv_id long, key binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = sorted((tuple(r) for r in prefix_trie(keys, kids, run).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_trie([(c, tuple(("", x) for x in s)) for c, s in rows])


def test_bitmaps_never_hide_a_link():
    """Sets that differ in n shingles differ in n bits at most, so the bound of _may_link holds for every similar pair."""
    import numpy as np

    from strandline.llm import dedup_oph as D

    rng = np.random.default_rng(6)
    for size in (1, 3, 40, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        far = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for cut in range(0, size, max(1, size // 7)):
            b = np.unique(np.concatenate([a[cut:], far[:cut]]))
            differ = int(np.bitwise_count((D.bitmap(a) ^ D.bitmap(b)).view(np.uint64)).sum())
            both = D.overlap(a, b)
            assert differ <= len(a) + len(b) - 2 * both
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert 175 * differ <= 25 * (len(a) + len(b))
    assert 175 * int(np.bitwise_count((D.bitmap(a[:400]) ^ D.bitmap(far[:400])).view(np.uint64)).sum()) > 25 * 800


def test_rounds_meet_no_pair_that_bitmaps_rule_out(spark, monkeypatch):
    """Texts that share one rare passage only: in its group no pair is a candidate."""
    from pyspark.sql import functions as F

    from strandline.llm import dedup_oph as D

    rows = [(n, 100, float(n) / 20, True, n) for n in range(20)]
    sets = [[int(x) for x in D.bitmap(__import__("numpy").arange(n * 1000, n * 1000 + 100, dtype="uint64"))] for n in range(20)]
    names = ", ".join(f"bits{k} long" for k in range(D.BITS // 64))
    left = spark.createDataFrame([(*r, *b) for r, b in zip(rows, sets, strict=True)], f"node long, size long, own double, few boolean, at long, {names}")
    right = left.select(F.col("node").alias("c_node"), F.col("size").alias("c_size"), *[F.col(f"bits{k}").alias(f"c_bits{k}") for k in range(D.BITS // 64)])
    pairs = left.crossJoin(right).where(D._may_link(75))
    assert {(r["node"], r["c_node"]) for r in pairs.collect()} == {(n, n) for n in range(20)}
