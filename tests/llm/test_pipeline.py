import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import corpus, documents, near_groups


def test_every_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rows = corpus(8, 120)
    bad = []
    for i in range(300, 420):
        y = i % 2
        rows.append([i, f"plain talk number {i} about things " + ("vile wretch vile " * 3 if y else "fine day "), "en", "s1"])
        bad.append((i, 1, y))
    rows = [r for r in rows if r[0] != 135]
    d = str(tmp_path)
    documents(spark, rows).select(*cp.COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bad, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, d)
    assert clean.columns == cp.COLUMNS
    left = {r["doc_id"] for r in clean.collect()}
    assert {r[0] for r in rows} - left == {i for i, _, y in bad if y}

    clean.write.parquet(f"{d}/1")
    kept = cp.drop_near_duplicates(spark, spark.read.parquet(f"{d}/1"), d)
    group, _ = near_groups([r for r in rows if r[0] in left])
    assert {r["doc_id"] for r in kept.collect()} == {i for i, g in group.items() if i == g}

    kept.write.parquet(f"{d}/2")
    mixed = cp.mix_sources(spark, spark.read.parquet(f"{d}/2"), d)
    assert mixed.columns == cp.COLUMNS
    assert sorted(map(str, mixed.collect())) == sorted(map(str, spark.read.parquet(f"{d}/2").select(*cp.COLUMNS).collect()))

    mixed.write.parquet(f"{d}/3")
    pieces = cp.pack_windows(spark, spark.read.parquet(f"{d}/3"), d).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {i: t for i, t, *_ in rows}
    got = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        got.setdefault(p["doc_id"], []).append(p)
    assert set(got) == {i for i, g in group.items() if i == g}
    for i, ps in got.items():
        ids, at = np.array(tok.encode(text[i] or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in ps:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert {p["doc_id"] for p in cp.run(spark, d).collect()} == set(got)


def test_queue_order_is_the_written_order(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [[i, f"word number {i}", "en", "s0"] for i in range(200)]
    mixed = cp.mix_sources(spark, documents(spark, rows), str(tmp_path))
    mixed.write.parquet(f"{tmp_path}/m")
    files = spark.read.parquet(f"{tmp_path}/m").selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index r").collect()
    order = [r["doc_id"] for r in sorted(files, key=lambda r: (r["f"], r["r"]))]
    pieces = cp.pack_windows(spark, spark.read.parquet(f"{tmp_path}/m"), str(tmp_path)).collect()
    packed = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert packed == order and order != sorted(order)


def test_packing_follows_the_mixture_of_many_sources(spark, tmp_path):
    """80 sources of equal size and null rows as many as all of them: each window has the mixture's shares."""
    import corpus_pipeline as cp

    rows = [[i, " ".join(["word"] * 200), "en", f"s{i % 80}" if i < 960 else None] for i in range(1920)]
    documents(spark, rows).select(*cp.COLUMNS).write.parquet(f"{tmp_path}/m")
    pieces = cp.pack_windows(spark, spark.read.parquet(f"{tmp_path}/m"), str(tmp_path)).collect()
    total = 80 * 12**0.5 + 960**0.5
    used, windows = {}, 20
    for p in pieces:
        if p["sequence_id"] < windows:
            used[p["queue"]] = used.get(p["queue"], 0) + p["length"]
    assert len(used) == 81
    for q, n in used.items():
        share = (960**0.5 if q == "*" else 12**0.5) / total
        assert abs(n / (windows * 2048) - share) < 0.05 * share
