"""Registered queries against their SQL, and all of them for their columns."""

import duckdb
import pytest

from framelode.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op3_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_html_main_text": ["page_id", "url", "text", "n_chars"],
    "op7_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def rows(values):
    return sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), c.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    expected = rows(want.project(", ".join(f'"{x}"' for x in cols)).fetchall())
    assert rows(map(tuple, got.select(*cols).collect())) == expected


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, DIR).columns == COLUMNS[name]
