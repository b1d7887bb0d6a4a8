import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, corpus, documents, near_groups, tokens


def load(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def test_encoder_equals_library():
    import random

    import pyarrow as pa

    from strandline.llm.fast_ids import FastEncoder

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "Bc", "é", "é", "1", ".", ",", "'s", "\t", " ", " ", "\x1c", "\x85", "Σ", "ß", "İ", "<|endoftext|>", "日", "!", "\r", "﻿", "\U0001f600", "the", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        lib, fast = load(name), FastEncoder(public_tokenizers.path(name))
        got = fast.encode_column(pa.array(texts, pa.string()))
        for t, g in zip(texts, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_token_store_round_trip(spark, tmp_path):
    from strandline.llm.token_store import lookup, read_tokens, tokens_query, write_tokens

    rows = corpus()
    tok, ids, start = load("byte_bpe_50k.json"), {}, 0
    expect = []
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda x: x[0]):
        ids[i] = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for _ in range(sum(r[0] == i for r in rows)):
            expect.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
            start += len(ids[i])
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted(map(tuple, tokens_query(documents(spark, rows), path).collect())) == sorted(expect)
    write_tokens(documents(spark, rows), str(tmp_path / "t"), path, 2)
    assert lookup(spark, str(tmp_path / "t"), 14) == ids[14]
    with pytest.raises(KeyError):
        lookup(spark, str(tmp_path / "t"), 10_000)
    # A dictionary that does not belong to the shards is refused.
    spark.createDataFrame([("other", bytearray())], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(str(tmp_path / "t/dictionary"))
    with pytest.raises(Exception, match="belong"):
        read_tokens(spark, str(tmp_path / "t")).collect()
    assert tokens_query(spark.createDataFrame([], DOCS), path).count() == 0


@pytest.mark.parametrize("targets", [None, {"s0": 1.0, "s1": 3.0}])
def test_pack_every_id_once(spark, targets):
    from strandline.llm.pack_drr import pack

    rows = [r for r in corpus() if r[0] != 75]  # the repeated id: pieces of equal rows cannot be told apart
    path, tok = public_tokenizers.path("word_bpe_49k.json"), load("word_bpe_49k.json")
    got = pack(documents(spark, rows), path, length=64, targets=targets).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    sizes = []
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 64 and sum(s < 64 for s in sizes) <= 1
    assert pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_pack_follows_targets():
    from strandline.llm.pack_drr import cut, plan_windows

    totals, targets, length = [0, 9000, 90_000, 30_000], [1, 1.0, 2.0, 1.0], 256
    plan = plan_windows(totals, targets, length)
    for q, share in ((1, 0.25), (2, 0.5), (3, 0.25)):
        firsts = [s[1][q] for s in plan]
        used = {}
        for _, n, w, _ in cut(plan, firsts, q, 0, totals[q], length):
            used[w] = used.get(w, 0) + n
        run = 0
        for w in range(100):  # before the first queue runs dry
            run += used.get(w, 0)
            assert abs(run - share * length * (w + 1)) <= 1 + 0.01 * (w + 1)


def test_near_duplicates_against_all_pairs(spark):
    from strandline.llm.dedup_oph import near_duplicates

    rows = corpus(2)
    group, sets = near_groups(rows)
    got = near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), group[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == group[r["doc_id"]])
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    none = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in none) == [("4", 4, True), ("None", 4, False), ("None", 4, False)]


def test_densified_signatures_estimate_similarity():
    from strandline.llm.dedup_oph import BINS, signature

    rng = np.random.default_rng(0)
    for size in (4, 40, 4000):
        same = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, 2 * size, dtype=np.uint64))
            s, t = np.sort(a[: size + size // 2]), np.sort(a[size // 2 :])
            j = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
            same.append((signature(s) == signature(t)).sum() / BINS - j)
        assert abs(np.mean(same)) < 0.1


def test_ppm_is_a_distribution_and_base_is_exact(spark):
    from strandline.llm.lm_ppm import BOUNDARY, count_corpus, fit, plain, score_documents

    rows = corpus(4)
    docs = documents(spark, rows)
    got = score_documents(docs).collect()
    assert len(got) == len(rows)
    seen, trained = Counter(), [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    for t in trained:
        seen.update([*tokens(t), b""])
    total, kinds = sum(seen.values()), len(seen)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        w = [*tokens(text[r["doc_id"]]), b""]
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[x] > 0 for x in w), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    model = fit(count_corpus(docs.select("text"), 3), 3)
    p = 10.0 ** model.cost.astype(float).reshape(-1, model.width)
    weights = np.ones(model.width)
    weights[-1] = model.unseen
    assert np.abs(p @ weights - 1).max() < 1e-5

    # Brute force: walk the contexts of each symbol with plain dictionaries.
    grams = Counter()
    for t in plain([(x or "").encode() for _, x, *_ in rows]):
        s = [BOUNDARY] * 3 + list(t) + [BOUNDARY]
        for k in range(3, len(s)):
            for n in range(4):
                grams[tuple(s[k - n : k + 1])] += 1
    by = {}
    for g, n in grams.items():
        by.setdefault(g[:-1], {})[g[-1]] = n

    def symbol(context, s):
        out, gone = 0.0, set()
        while True:
            held = {k: n for k, n in by.get(context, {}).items() if k not in gone}
            if held:
                t = sum(held.values())
                if s in held:
                    return out + math.log10((held[s] - 0.4) / t)
                out += math.log10(0.4 * len(held) / t)
                gone |= set(held)
            if not context:
                return out - math.log10(257 - len(gone))
            context = context[1:]

    for t in (b"the of", b"", b"zz qq\xff"):
        s = [BOUNDARY] * 3 + list(t) + [BOUNDARY]
        assert model.score([t])[0] == pytest.approx(sum(symbol(tuple(s[k - 3 : k]), s[k]) for k in range(3, len(s))), rel=1e-4)
    assert score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_media_round_trip(spark):
    from strandline.llm.media_cdc import chunks_of, media_query, payload_of

    rows = corpus(5)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    got = media_query(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    same = {}
    for r in got:
        p = payload_of(text[r["doc_id"]])
        assert len(p) % 576 == 0 and p
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        value = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert same.setdefault(p, value) == value
    p = payload_of(text[74])
    assert b"".join(x for _, x in chunks_of(p)) == p
    cut = {d for d, _ in chunks_of(payload_of(b"prefix that moves everything " + text[74]))}
    assert len({d for d, _ in chunks_of(p)} & cut) >= 0.5 * len(chunks_of(p))
    assert media_query(spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity_held_out(spark):
    import random

    from strandline.llm.toxicity_fst import Classes, tapes, toxicity_scores

    rng = random.Random(7)
    bad = ["vile", "scoundrel", "wretch", "rotten"]
    rows, labels = [], []
    from tests.llm.helpers import words

    for i in range(900):
        w, y = words(rng, rng.randint(5, 60)), int(rng.random() < 0.25)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append([i, " ".join(w), "en", "s0"])
        labels.append((i, 1, y))
    rows += [[2000, None, None, None], [2001, "", "en", "s0"]]
    labels += [(5, None, None), (77, 0, 7)]
    got = {r["doc_id"]: r for r in toxicity_scores(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], y) for i, _, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) / len(held) > 0.95 and sum(p and not y for p, y in held) == 0
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and got[2000]["score"] == got[2001]["score"]
    c = Classes({"idiot": 4.0, "réeu*": 3.0})
    plain, negated = tapes("You are an idiot.", c), tapes("You are not an idiot.", c)
    told, quoted, menace = tapes("He said: fine. They called you an idiot", c), tapes('"an idiot"', c), tapes("I will kill them", c)
    assert plain[3] == 4.0 and negated[1] == 4.0 and told[2] == 4.0 and quoted[2] == 4.0 and menace[4] == 1.0
    assert plain[6] > negated[6] > 0 and tapes("réeuxpa", c)[0] == 3.0 and tapes("", c) == [0.0] * 8
    assert tapes("to kill time is no crime", c)[5] == 0  # nobody near: no match
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity_scores(documents(spark, rows[:5]), empty).collect()} == {0}
    assert toxicity_scores(spark.createDataFrame([], DOCS), empty).count() == 0


def test_grammar_against_a_plain_reading(spark):
    """The composed transducer writes what positions in the clause say, for random clauses."""
    import random

    from strandline.llm import toxicity_fst as T

    c = T.Classes({"idiot": 4.0, "fool": 2.0})
    words = {"idiot": T.INSULT, "fool": T.INSULT, "kill": T.THREAT, "you": T.TARGET, "not": T.NEGATOR, "said": T.SAYS, '"': T.QUOTE, "a": T.NONE, "b": T.NONE, ".": T.STOP}

    def plain(tokens):
        out = [0.0] * 8
        out[T.WORDS] = len(tokens)
        if not any(words[t] in (T.INSULT, T.THREAT) for t in tokens):
            return out
        clauses, now = [], []
        for t in [*tokens, "."]:
            if t == ".":
                clauses.append(now)
                now = []
            else:
                now.append(t)
        for clause in clauses:
            kinds, held, near, total, direct = [words[t] for t in clause], [], None, 0.0, 0.0
            for k, (t, kind) in enumerate(zip(clause, kinds)):
                if kind == T.INSULT:
                    held.append((k, c.weights[c[t] >> 3], False))
                if kind in (T.THREAT, T.TARGET):  # the nearest other one, each used once
                    if near and near[0] != kind and k - near[1] <= T.REACH:
                        held.append((k, 1.0, True))
                        near = None
                    else:
                        near = (kind, k)
            for k, w, violent in held:
                denied = T.NEGATOR in kinds[max(0, k - T.NEGATION_SCOPE) : k]
                told = T.SAYS in kinds[:k] or kinds[:k].count(T.QUOTE) % 2 == 1
                out[T.NEGATED if denied else T.REPORTED if told else T.MENACE if violent else T.PLAIN] += 0 if not (denied or told or violent) else w
                direct += 0 if denied or told or violent else w
                total += w * (0.3 if denied else 1.0) * (0.5 if told else 1.0)
            person = T.TARGET in kinds
            out[T.TARGETED if person else T.PLAIN] += direct
            if held:
                out[T.CLAUSES] += 1
                out[T.PEAK] = max(out[T.PEAK], total + (0.2 * direct if person else 0))
        return out

    rng = random.Random(9)
    for _ in range(3000):
        tokens = rng.choices(list(words), [3, 2, 3, 3, 2, 1, 1, 6, 6, 2], k=rng.randint(0, 30))
        assert T.tapes(" ".join(tokens), c) == pytest.approx(plain(tokens)), tokens


def test_media_forms_are_what_the_files_hold(spark, tmp_path):
    from strandline.llm import media_cdc as M

    text = {i: (t or "").encode() for i, t, *_ in corpus(5)}
    path = str(tmp_path / "m")
    M.store(documents(spark, corpus(5)).select("doc_id", "text"), path)
    bodies = {bytes(r["digest"]): bytes(r["body"]) for r in spark.read.parquet(f"{path}/chunks").collect()}
    forms = {}
    for r in spark.read.parquet(f"{path}/recipes").collect():
        named = [bodies[d] for s, _, d in M.entries_of(bytes(r["recipe"])) if s]
        forms[bytes(r["media"])] = bytes(r["recipe"]) + bytes(r["own"]) + b"".join(named)
    for r in M.read(spark, path).collect():
        form = forms.pop(bytes(r["media"]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
    assert not forms
    with pytest.raises(ValueError, match="recipe"):
        M.entries_of(b"CDC1x")
    assert len(text) > 0


def test_ppm_nodes_grow_with_the_corpus(spark, monkeypatch):
    """Scores of the bucketed trie are those of the trie in one table, whatever the batches; rare contexts are kept."""
    from strandline.llm import lm_ppm

    docs = documents(spark, corpus(4))
    trained = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    whole = lm_ppm.fit(lm_ppm.count_corpus(trained.select("text")))
    monkeypatch.setattr(lm_ppm, "BATCH", 5000)
    monkeypatch.setattr(lm_ppm, "BUCKET", 500)
    held = docs.selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 AS held_out")
    read = lm_ppm.read_corpus(held)
    assert read.where("kind = 2").select("batch").distinct().count() > 1
    costs = {r["key"]: r["cost"] for r in lm_ppm.priced(read, least=1).collect()}
    for _, t, *_ in corpus(4):
        t = lm_ppm.plain([(t or "").encode()])
        assert sum(costs[k] for k in lm_ppm.grams(t).tolist()) == pytest.approx(whole.score(t)[0], rel=1e-4)
    # A context of three occurrences counts beside any number of other texts.
    texts = [("zq" * 6 + "x",)] * 3 + [("the of and " * 300,)] * 40
    many = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts * 4)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_ppm.score_documents(many).collect()}
    seen = lm_ppm.priced(lm_ppm.read_corpus(many.selectExpr("doc_id", "text", "false AS held_out")))
    cost = {r["key"]: r["cost"] for r in seen.collect()}
    deep = lm_ppm.grams([b"zq" * 6 + b"x"])[12]
    assert len(got) == len(texts) * 4 and cost[int(deep)] > -1


def test_near_duplicates_in_a_family_below_the_threshold(spark, monkeypatch):
    """All texts share a bucket by their passage; similar ones are found though none of them is similar to the first centers."""
    from strandline.llm import dedup_oph

    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(40):
        own = [f"x{i // 2}_{k}" for k in range(30)]
        rows.append([i, " ".join(passage + own + ([f"y{i}"] if i % 2 else [])), "en", "s0"])
    group, _ = near_groups(rows)
    assert len(set(group.values())) == 20
    # The workers import bands themselves, so profiles are made here.
    sets = dedup_oph.shingle_sets([r[1].encode() for r in rows])
    profile = [(r[0], len(s), dedup_oph.set_digest(s), [1]) for r, s in zip(rows, sets, strict=True)]
    made = spark.createDataFrame(profile, "doc_id long, n_shingles long, node long, keys array<long>")
    monkeypatch.setattr(dedup_oph, "_profiles", lambda docs: made)
    got = {r["doc_id"]: r["component_id"] for r in dedup_oph.near_duplicates(documents(spark, rows)).collect()}
    assert got == group


def test_near_duplicates_loses_no_pair_of_a_template(spark):
    """Pairs at 0.77 in a family whose other pairs are at 0.74: every bucket is full of strangers, every pair is found."""
    from strandline.llm.dedup_oph import near_duplicates

    template = [f"p{k}" for k in range(320)]
    rows = [[i, " ".join(template + [f"q{i // 2}_{k}" for k in range(8)] + [f"x{i}_{k}" for k in range(48)]), "en", "s0"] for i in range(80)]
    group, sets = near_groups(rows)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert share(0, 1) > 0.75 > share(0, 2) > 0.73 and len(set(group.values())) == 40
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows)).collect()} == group


def test_ppm_workers_hold_little_beside_their_grams():
    import tracemalloc

    from strandline.llm import lm_ppm

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 400_000, dtype=np.uint8)) for _ in range(3)]
    every = lm_ppm.grams(texts)
    levels = [np.unique(every & ((1 << (9 * (k + 1))) - 1), return_counts=True) for k in range(3)]
    asked = np.unique(every)
    tracemalloc.start()
    try:
        costs = lm_ppm.prices(levels, asked)
        assert tracemalloc.get_traced_memory()[1] < 60 * len(asked)
        tracemalloc.reset_peak()
        keys, n = asked[::2].copy(), np.ones(len(asked[::2]), np.int64)
        more = asked[::40], np.full(len(asked[::40]), 2)
        before = tracemalloc.get_traced_memory()[0]
        got = lm_ppm.added(keys, n.copy(), *more)
        assert tracemalloc.get_traced_memory()[1] - before < 40 * len(keys)
    finally:
        tracemalloc.stop()
    assert all((x == y).all() for x, y in zip(got, lm_ppm.merged([(keys, n), more]), strict=True))
    odd = np.unique(np.concatenate([asked[1::50], asked[:3]]))
    assert all((x == y).all() for x, y in zip(lm_ppm.added(keys, n.copy(), odd, odd), lm_ppm.merged([(keys, n), (odd, odd)]), strict=True))
    # A span at a time gives each gram the price that it has alone.
    assert np.array_equal(costs[::10_000], np.concatenate([lm_ppm.prices(levels, asked[k : k + 1]) for k in range(0, len(asked), 10_000)]))


def test_ppm_holds_a_batch_in_parts(monkeypatch):
    """What a batch's keys take is a word and half each; merging and giving them out copies no more than a part."""
    import tracemalloc

    from strandline.llm import lm_ppm

    monkeypatch.setattr(lm_ppm, "PENDING", 100_000)
    rng = np.random.default_rng(6)
    slices = [rng.integers(0, 1 << 62, 50_000) for _ in range(40)]

    def filled():
        held = lm_ppm.Held(64, lm_ppm.ORDER)
        for x in slices:
            held.add(*np.unique(x, return_counts=True))
            held.add(np.unique(x[:100]), np.ones(100, np.int64))
        return held

    distinct = len(np.unique(slices))
    tracemalloc.start()
    try:
        assert sum(len(keys) for _, keys, _ in filled().given_up()) == distinct
        assert tracemalloc.get_traced_memory()[1] < 24 * distinct
    finally:
        tracemalloc.stop()
    got = list(filled().given_up())
    assert sorted({b for b, *_ in got}) == [b for b, *_ in sorted(got, key=lambda x: x[0])]
    for bucket, keys, _ in got:
        assert (keys[1:] > keys[:-1]).all() and (lm_ppm._dealt(keys, 64, lm_ppm.ORDER) == bucket).all()
    want = lm_ppm.merged([np.unique(np.concatenate(slices), return_counts=True), *[(np.unique(x[:100]), np.ones(100, np.int64)) for x in slices]])
    assert all((x == y).all() for x, y in zip(lm_ppm.merged([x[1:] for x in got]), want, strict=True))


def test_ppm_rows_and_arrow_batches_stay_small(spark):
    from strandline.llm import lm_ppm
    from strandline.llm.common import arrow_rows

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (b.from_pydict({"id": [b.num_rows]}) for b in batches), "id long")
    with arrow_rows(spark, 7):
        assert max(r["id"] for r in sizes.select("*").collect()) == 7
        with arrow_rows(spark, 1000):
            assert spark.conf.get(key) == "7"
    with pytest.raises(ZeroDivisionError), arrow_rows(spark, 7):
        1 / 0
    assert spark.conf.get(key) == before
    docs = spark.createDataFrame([(k, f"{k} whole and {k * k} parts, some of {k % 7}'s own " * 20) for k in range(200)], "doc_id long, text string")
    read = lm_ppm.read_corpus(docs.selectExpr("doc_id", "text", "false AS held_out"))
    assert read.where("kind = 1").select("bucket").distinct().count() > 64  # rows of a large batch are below half a MB
    assert lm_ppm.score_documents(docs).count() == 200 and spark.conf.get(key) == before
