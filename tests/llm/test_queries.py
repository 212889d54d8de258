"""The registered queries: contract columns and types, DuckDB where SQL can say it."""

import duckdb
import pytest

from ballotline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_secrets": "doc_id bigint, n_candidates bigint, n_secrets bigint, kinds string, score double",
    "op4_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_decontamination": "doc_id bigint, n_items bigint, items array<bigint>, contaminated boolean",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_line_dedup": "doc_id bigint, text string, n_lines bigint, n_removed_lines bigint",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}
#: Contract columns of op1, op2 and op7 that SQL can express.
FIXED = {
    "license_base": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string",
    "quality_base": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean",
    "mixing_targets": "doc_id bigint, size bigint, source_size bigint, target double",
}
COLUMNS |= FIXED


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.rsplit(" ", 1) for x in COLUMNS[name].split(", "))} == dict(x.rsplit(" ", 1) for x in COLUMNS[name].split(", "))
    table = "pages" if name in ("op4_extraction", "op9_warc") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for table in ("pages", "documents"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
