"""The registered queries on the smallest tables: against SQL where there is some, else that every row comes back in the stated form."""

import duckdb
import pytest

from axonlake.llm import queries as llm

SF = "/root/testdata/sf0.001"
#: First columns and types that are agreed for each query.
FORM = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_urls": "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, SF)
    got = df.collect()
    if name in FORM:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(FORM[name])
    tables = {"op5_embedding_dedup": "embeddings", "op10_decontaminate": None, "op12_urls": "pages"}
    if table := tables.get(name, "documents"):
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect())
        assert sorted(r[0] for r in got) == ids
    else:
        assert got and len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    at = SF.replace("sf0.001", sf)
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = llm.queries()[name](spark, at)
    want = duck.sql(llm.oracle_sql()[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
