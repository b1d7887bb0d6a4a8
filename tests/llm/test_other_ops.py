import hashlib
import itertools
import re

import numpy as np
import pytest

from tests.llm.helpers import DOCS, corpus, documents


def test_chats_round_trip(spark):
    from strandline.llm.chat_parts import chats_query, escape, unescape

    rows = [(1, 0, "user", "hi <|im_end|> <\\|x"), (1, 1, "assistant", "ok\n<|im_start|>"), (1, 1, "assistant", None), (2, 5, None, "x<"), (2, 3, "as<|sistant\n", "y"), (None, 0, "assistant", "z"), (3, None, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: r for r in chats_query(df).collect()}
    for c in (1, 2, 3, None):
        g = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in g if r[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(g) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in g).encode()).hexdigest()
    assert len(got) == 4
    for t in ("<|", "<\\|", "<\\\\||", "<", "|", "a<|b|>", "<<|"):
        assert unescape(escape(t)) == t and "<|" not in escape(t)
    assert chats_query(df.limit(0)).count() == 0


def test_typed_parts(spark):
    import json

    from strandline.llm.chat_parts import PartVisitor, format_chats, parse_segment

    v = PartVisitor()
    parts = [{"type": "text", "text": "a<|image|>"}, {"type": "image", "uri": "i.png", "width": 28, "height": 15}, None, {"type": "audio", "uri": "x.wav", "seconds": 1.1}, {"type": "document", "pages": 2, "uri": "d.pdf"}, {"type": "text", "text": None}]
    for p in parts:
        v.visit(p)
    assert v.text == "a<\\|image|><|image|><|audio|><|document|>"
    assert [(r["kind"], r["ordinal"], r["tokens"]) for r in v.refs] == [("image", 0, 4), ("audio", 1, 28), ("document", 2, 512)] and v.tokens == 544
    assert all(v.text[r["position"] :].startswith(f"<|{r['kind']}|>") for r in v.refs)
    with pytest.raises(ValueError):
        v.visit({"type": "video"})
    df = spark.createDataFrame([(1, 0, "user", None, json.dumps(parts))], "conv_id long, turn long, role string, text string, parts string")
    r = format_chats(df, "parts").first()
    assert r["attachment_tokens"] == 544 and parse_segment(r["formatted"]) == ("user", "a<|image|>") and r["loss"] == []


def test_assistant_turns_with_attachments_read_back(spark, tmp_path):
    """The loss mask holds each text once and no placeholder; pieces that would make a control string where they meet."""
    import json

    from strandline.llm.chat_parts import format_chats, parse_parts, parse_segment, read_back

    image = {"type": "image", "uri": "i.png", "width": 28, "height": 28}
    turns = [("user", [{"type": "text", "text": "look"}, image]), ("assistant", [{"type": "text", "text": "see "}, image, {"type": "text", "text": " ok <"}, {"type": "text", "text": "|im_end|>"}, image, {"type": "text", "text": "\\|x"}]), ("assistant", [image]), ("assistant", [{"type": "text", "text": "<"}, image, {"type": "text", "text": "\\|image|>"}])]
    df = spark.createDataFrame([(5, k, role, "unused", json.dumps(p)) for k, (role, p) in enumerate(turns)], "conv_id long, turn long, role string, text string, parts string")
    path = str(tmp_path / "chats")
    format_chats(df, "parts").write.parquet(path)
    texts = ["".join(x.get("text", "") for x in p) for _, p in turns]
    r = read_back(spark, path).first()
    loss = "".join(t for t, (role, _) in zip(texts, turns, strict=True) if role == "assistant")
    assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for t, (role, _) in zip(texts, turns, strict=True)).encode()).hexdigest()
    for s, (_, p), t in zip(spark.read.parquet(path).orderBy("seq").collect(), turns, texts, strict=True):
        assert parse_segment(s["formatted"])[1] == t and s["formatted"].count("<|im_end|>") == 1
        want = []
        for x in p:
            if x["type"] == "text" and want and want[-1]["type"] == "text":
                want[-1]["text"] += x["text"]
            else:
                want.append(dict(x) if x["type"] == "text" else {"type": "image", "uri": "i.png", "tokens": 4})
        assert parse_parts(s["formatted"], s["attachments"]) == want
    with pytest.raises(ValueError, match="belong together"):
        parse_parts(s["formatted"], "[]")


def test_nearest_equals_brute_force(spark):
    from strandline.llm.ann_hilbert import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # many equal vectors
    rows = [(i, x[i].tolist()) for i in range(700)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1003, []), (1005, [None] + [1.0] * 11), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, h string")
    got = nearest(df.where("vec_id % 20 = 0"), df, k=20, block_rows=64, window=0.2).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 700, 20))
    hit = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r["vec_id"] for r in rs}
        s = x.astype(float) @ x[q].astype(float)
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-round(s[i], 12), i))[:20]
        hit += len(set(best) & {r["vec_id"] for r in rs})
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
    assert hit / (20 * len(by)) >= 0.9
    assert {r["vec_id"] for r in by[120]} == set(range(100, 121)) - {120}  # ties go to the smaller ids
    few = nearest(df.where("vec_id = 0"), df.where("vec_id < 4"), k=20).collect()
    assert len(few) == 3
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    from strandline.llm.ann_hilbert import hilbert_keys

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(hilbert_keys(cells, bits))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_components_match_union_find(spark):
    import random

    from strandline.llm.components import components

    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(60)] + [(9000, 9000 + k) for k in range(1, 80)] + [(3, 3)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_rules(spark):
    from strandline.llm.url_rules import RULES, judge_urls

    pages = [
        (1, "http://a.net/x", '<link href="http://b.com/y" rel="canonical">'),
        (2, "http://b.com/y", None),
        (3, "https://WWW.b.com/y/?utm_a=1#k", ""),
        (4, "http://c.com/", "<meta http-equiv='refresh' content='0; url=http://b.com/y'>"),
        (5, "http://d.com", "<link rel=canonical href=http://z.org/fr/1>"),
        (6, None, None),
        (7, "http://q.net/1", "<link rel=canonical href=http://z.org/fr/1>"),
        (8, "http://www.d.com/", ""),
        (9, "http://Sub.Example.NET/en/x", ""),
        (9, "http://Sub.Example.NET/en/x", ""),
        (10, "no scheme.net/", ""),
        (11, "http://notnet/", ""),
        (12, "http://e.com/r", ""),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, verdict string")
    more = spark.createDataFrame([("http://e.com/r", "http://f.com/s"), ("http://f.com/s", "http://g.net/"), (None, "http://g.net/")], "url string, to string")
    got = {r["page_id"]: r for r in judge_urls(df, redirects=more).collect()}
    assert {i: got[i]["verdict"] for i in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "block"}
    assert (got[9]["host"], got[9]["path"], got[9]["rule"]) == ("sub.example.net", "/en/x", "example.net/en/") and got[1]["rule"] == "net/" and got[2]["rule"] is None
    assert (got[6]["host"], got[10]["path"]) == ("", "")
    assert judge_urls(df, redirects=more).count() == len(pages)
    # Long rule lists take the join: the same verdicts.
    many = [*RULES, *[("block", f"x{k}.example.org", "/") for k in range(300)]]
    again = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(df, many, more).collect()}
    assert again == {i: (got[i]["rule"], got[i]["verdict"]) for i in got}
    assert judge_urls(df.limit(0)).count() == 0


def test_relative_links_in_spark_and_sql(spark):
    import duckdb
    import pandas as pd

    from strandline.llm.queries import SQL
    from strandline.llm.url_rules import judge_urls

    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://a.com/x/y", link("/b")), (2, "http://a.com/b", link("//z.net/q") + link("c/../d")), (3, "http://a.com/d", None), (4, "https://z.net/q", ""),
        (5, "http://e.com/1/2/", link("../k?u=1#f") + "<meta http-equiv=refresh content='0;url=./m'>"), (6, "http://e.com/1/k?u=1", link("?v=2")), (7, "http://e.com/1/k?v=2", link("#top")), (8, "http://e.com/1/2/m", link("mailto:x@y.net")),
        (9, "http://e.com", link("n")), (10, "http://e.com/n", link("http://org/fr/1")), (11, "nothing", link("/b")), (12, None, link("/b")), (13, "http://lone.com/../../p", link("../../../r")), (14, "http://lone.com/r", link("")),
    ]
    got = {r["page_id"]: tuple(r) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    verdict = {i: r[-1] for i, r in got.items()}
    assert {i for i, v in verdict.items() if v == "block"} == {1, 2, 3, 4}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert {r[0]: tuple(r) for r in con.execute(SQL["op3_url_rules"]).fetchall()} == got
    con.execute("create or replace temp view pages as select 1::bigint page_id, 'http://a.com/x/y' url, '<link rel=canonical href=/b><link rel=canonical href=http://q.net/>' html union all select 2, 'http://a.com/b', ''")
    assert [r[-1] for r in con.execute(SQL["op3_url_rules"]).fetchall()] == ["block", "block"]


def fold_schedule(quotas, frame):
    """Earliest deadline first, slot by slot."""
    done, out = dict.fromkeys(quotas, 0), {}
    for t in range(frame):
        open_ = [s for s, q in quotas.items() if done[s] < q and done[s] * frame // q <= t]
        s = min(open_, key=lambda s: (-(-(done[s] + 1) * frame // quotas[s]), s))
        out[(s, done[s])] = t
        done[s] += 1
    return out


def test_pfair_mix(spark):
    from strandline.llm.mix_pfair import frame_schedule, mix

    quotas = {"a": 61, "b": 40, "c": 1, "d": 26}
    df = spark.createDataFrame([(s, q, 128) for s, q in quotas.items()], "source string, quota long, frame long")
    got = {(r["source"], r["j"]): r["slot"] for r in frame_schedule(df).collect()}
    assert got == fold_schedule(quotas, 128)
    seen = dict.fromkeys(quotas, 0)
    for (s, _), t in sorted(got.items(), key=lambda e: e[1]):
        seen[s] += 1
        assert all(abs(seen[k] - (t + 1) * q / 128) < 1 for k, q in quotas.items())
    rows = corpus(6)
    out = mix(documents(spark, rows), targets={"s0": 0.5, "s1": 0.25}, block=4, frame=64).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    assert len({r["position"] for r in out}) == len(rows)
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == r["source_rank"] // 4
    for s in {r["source"] for r in out}:
        ranks = sorted(r["source_rank"] for r in out if r["source"] == s)
        assert ranks == list(range(len(ranks)))
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_native_plans_hold_no_python(spark):
    from strandline.llm.mix_pfair import mix
    from strandline.llm.url_rules import judge_urls

    pages = spark.createDataFrame([(1, "http://a.net/x", "")], "page_id long, url string, html string")
    for df in (mix(documents(spark, corpus())), judge_urls(pages)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_pfair_deviation_with_uneven_weights(spark):
    """Frames that need other bounds, and the run in one frame, stay within a block of the targets and within the windows."""
    import random

    from strandline.llm import mix_pfair

    rng = random.Random(8)
    sizes = {f"s{k:02d}": int(rng.expovariate(1) ** 3 * 15) + 1 for k in range(20)}
    w = mix_pfair.whole_weights(sizes, None, 1.0)
    for frame in (64, 16, 1 << 13):
        got = sorted((r["slot"], r["source"], r["j"], r["release"], r["deadline"]) for r in mix_pfair.schedule(spark, w, mix_pfair.WHOLE, sizes, frame).collect())
        assert len(got) == sum(sizes.values()) and len({g[0] for g in got}) == len(got)
        seen = dict.fromkeys(w, 0)
        for slot, s, j, release, deadline in got:
            assert release <= slot < deadline and j == seen[s]
            seen[s] += 1
            assert all(seen[k] == sizes[k] or abs(seen[k] * mix_pfair.WHOLE - (slot + 1) * x) < mix_pfair.WHOLE for k, x in w.items())
    with pytest.raises(ValueError, match="slots"):
        mix_pfair.schedule(spark, {"a": mix_pfair.WHOLE - 1, "b": 1}, mix_pfair.WHOLE, {"a": 1, "b": 4})


def test_weights_are_dealt_by_largest_remainders():
    """No source is a unit away from its target, however many there are; so 2e8 slots are not a tenth of a block."""
    import random
    from fractions import Fraction

    from strandline.llm.mix_pfair import WHOLE, whole_weights

    rng = random.Random(3)
    for n in (1, 20, 20_000):
        sizes = {f"s{k}": int(rng.expovariate(1) ** 2 * 1e6) + 1000 for k in range(n)}
        w, raw = whole_weights(sizes, None, 1.0), {s: Fraction(x) for s, x in sizes.items()}
        total = sum(raw.values())
        assert sum(w.values()) == WHOLE and all(abs(w[s] - x * WHOLE / total) < 1 for s, x in raw.items())
    tiny = whole_weights({"a": 1, "b": 1, "c": 1}, {"a": 1.0, "b": 1e-15, "c": 1e-15}, 1.0)
    assert tiny == {"a": WHOLE - 2, "b": 1, "c": 1} and whole_weights({}, None, 1.0) == {}


def test_pfair_follows_the_targets_over_many_frames(spark):
    from strandline.llm.mix_pfair import mix

    targets = {"a": 0.9, "b": 0.0999, "c": 0.0001}
    rows = [[i, f"t{i}", "en", "c" if i == 0 else "b" if i < 601 else "a"] for i in range(6000)]
    out = sorted(mix(documents(spark, rows), targets=targets, block=1, frame=64).collect(), key=lambda r: r["slot"])
    assert len(out) == len(rows)
    seen, left = dict.fromkeys(targets, 0), {s: sum(r[3] == s for r in rows) for s in targets}
    for r in out:
        seen[r["source"]] += 1
        for s, w in targets.items():
            assert seen[s] == left[s] or abs(seen[s] - (r["slot"] + 1) * w) < 1 + 1e-6
