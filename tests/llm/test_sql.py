import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_url_rules", "op7_near_duplicates", "op9_chat_parts", "op11_scaled_sketch", "op12_prefix_trie"])
def test_query_equals_sql(spark, name):
    from strandline.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[k] for k in columns) for r in got.collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)


def test_every_query_has_its_contract_columns(spark):
    from strandline.llm.queries import QUERIES

    want = {
        "op1": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")],
        "op2": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
        "op3": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
        "op5": [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
        "op6": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")],
        "op7": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
        "op8": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op11": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
        "op12": [(x, "bigint") for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")],
        "op9": [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")],
        "op10": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    }
    for name, f in QUERIES.items():
        columns = want.get(name.split("_")[0], [])
        assert f(spark, DATA).dtypes[: len(columns)] == columns, name
