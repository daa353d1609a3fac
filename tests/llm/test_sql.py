"""The queries that have SQL, against it, on the driver's small tables; and the contract's columns."""

import os

import duckdb
import pytest

from leafmill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_mixture": ["doc_id", "held_out", "lang_pred", "score"], "op2_toxicity_fm": ["doc_id", "held_out", "score", "predicted"], "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_site_style_tree": ["page_id", "url", "text", "n_chars"], "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op6_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op7_bpe_roundtrip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8_embedding_graph": ["vec_id", "n_links", "component_id", "kept"], "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op11_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables absent")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    r = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(tuple(map(str, x)) for x in QUERIES[name](spark, DATA).select(*columns).collect()) == sorted(tuple(map(str, x)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table, key = {"op4_site_style_tree": ("pages", "page_id"), "op8_embedding_graph": ("embeddings", "vec_id"), "op11_url_filter": ("pages", "page_id"), "op13_vector_codes": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = spark.read.parquet(f"{DATA}/{table}.parquet").select(key)
    assert df.count() == ids.count() and df.select(key).exceptAll(ids).count() == 0
