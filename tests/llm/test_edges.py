"""Null ids, empty tables and extra columns, for the operators and the stages of the pipeline."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, documents, tokens

ROWS = [[1, "one two three four five six", "en", "a"], [None, "one two three four five six", "en", "a"], [None, None, None, None], [2, "", "en", "b"], [3, "seven eight " * 40, "en", None], [3, "seven eight " * 40, "en", None]]


def test_null_ids(spark):
    from strandline.llm.lm_ppm import score_documents
    from strandline.llm.media_cdc import media_query
    from strandline.llm.mix_pfair import mix
    from strandline.llm.pack_drr import pack
    from strandline.llm.token_store import tokens_query
    from strandline.llm.toxicity_fst import toxicity_scores

    df = documents(spark, ROWS)
    ids = sorted(str(r[0]) for r in ROWS)
    labels = spark.createDataFrame([(2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")

    scored = score_documents(df).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == ids
    assert all(r["held_out"] and r["n_tokens"] in (1, 7) for r in scored if r["doc_id"] is None)
    toxic = toxicity_scores(df, labels).collect()
    assert sorted(str(r["doc_id"]) for r in toxic) == ids and all(r["held_out"] for r in toxic if r["doc_id"] is None)
    assert sorted(str(r["doc_id"]) for r in mix(df).collect()) == ids
    media = media_query(df).collect()
    assert sorted(str(r["doc_id"]) for r in media) == ids
    same = {(r["media_sha256"], r["payload_sha256"], r["feature"]) for r in media if r["n_bytes"] == len(ROWS[0][1])}
    assert len(same) == 1  # the same text under an id and without one
    path = public_tokenizers.path("byte_bpe_50k.json")
    stored = sorted(tokens_query(df, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in stored] == [None, None, 1, 2, 3, 3] and stored[0]["start"] == 0
    word = public_tokenizers.path("word_bpe_49k.json")
    size = len(Tokenizer.from_file(word).encode(ROWS[1][1], add_special_tokens=False).ids) + 1
    pieces = pack(df, word, length=64).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] is None) == size + 1
    assert {str(r["doc_id"]) for r in pieces} == set(ids)


def test_one_very_long_text(spark):
    from strandline.llm.chat_parts import chats_query
    from strandline.llm.lm_ppm import score_documents
    from strandline.llm.toxicity_fst import toxicity_scores

    text = "alpha beta gamma. " * 60_000
    df = documents(spark, [[11, text, "en", "a"], [12, "alpha", "en", "a"]])
    r = {x["doc_id"]: x for x in score_documents(df).collect()}
    assert r[11]["n_tokens"] == len(tokens(text)) + 1 and r[11]["score"] < r[12]["score"] < 0
    labels = spark.createDataFrame([(12, 1, 0)], "doc_id long, quality int, toxic int")
    assert {x["predicted"] for x in toxicity_scores(df, labels).collect()} == {0}
    chat = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chats_query(chat).first()["loss_chars"] == len(text)


def test_stages_on_empty_tables_nulls_and_extra_columns(spark, tmp_path):
    import corpus_pipeline as cp

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    documents(spark, ROWS).write.parquet(f"{d}/some")  # with columns node, key and score
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/none")
    for name, f in cp.STAGES:
        some, none = f(spark, spark.read.parquet(f"{d}/some"), d), f(spark, spark.read.parquet(f"{d}/none"), d)
        assert none.count() == 0
        if name != "packing":
            assert some.columns == none.columns == cp.COLUMNS
        want = {"toxicity": 6, "near_duplicates": 6, "mixture": 6}
        if name in want:
            # Near-duplicates: the texts of ids 1 and 3 with their copies are kept by id, rows without id stay.
            assert some.count() == want[name], name
        else:
            assert {str(r["doc_id"]) for r in some.collect()} == {"None", "1", "2", "3"}


def test_search_at_default_parameters(spark):
    """Recall of the query on whole tables, its scores and order against all pairs."""
    from strandline.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"] is not None and None not in r["embedding"]}
    rows = {i: x for i, x in rows.items() if np.isfinite(x).all() and x.any()}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got: dict = {}
    for r in QUERIES["op2_hilbert_ann"](spark, d).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ rows[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(best.tolist()) & {v for v, _ in found.values()})
        assert sorted(found) == list(range(1, 21)) and all(sc == pytest.approx(float(rows[q] @ rows[v]), abs=1e-12) for v, sc in found.values())
    assert hits >= 0.9 * 20 * len(got)
