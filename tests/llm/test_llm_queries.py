"""The thin queries: columns and types of the contract, and their SQL where there is one."""

from collections import Counter

import pytest

from nasaq.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    2: "doc_id bigint, held_out boolean, lang_pred string, score double",
    3: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    5: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    6: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    7: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    8: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    9: "page_id bigint, host string, path string, rule string, verdict string",
    10: "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    got = QUERIES[name](spark, SF)
    if n in COLUMNS:
        assert ", ".join(" ".join(c) for c in got.dtypes) == COLUMNS[n]
    rows = got.collect()
    if n not in (9, 10):
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    if name in ORACLE_SQL:
        import duckdb

        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cols = sorted(got.columns)
        want = c.sql(ORACLE_SQL[name]).select(", ".join(cols)).fetchall()
        assert Counter(tuple(r[k] for k in cols) for r in rows) == Counter(want)
