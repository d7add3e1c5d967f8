"""Every registered query gives the columns that its contract names."""

import pytest

from trialframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_url_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_secret_scan": {
        "doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"
    },
    "op9_decontaminate": {
        "doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"
    },
    "op10_fingerprints": {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
        "near_edited": "double", "near_next": "double",
    },
    "op11_fill_in_middle": {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string",
    },
    "op12_collocations": {
        "lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"
    },
    "op13_chat_format": {
        "conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
        "formatted_chars": "bigint",
    },
    "op2_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids": "array<int>", "decoded_sha256": "string", "round_trip": "boolean"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
ROWS = {"op4_url_rules": "pages", "op12_collocations": None, "op13_chat_format": None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_the_columns_and_rows_of_its_contract(spark, name):
    found = QUERIES[name](spark, FOLDER)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    source = ROWS.get(name, "documents")
    if source is not None:
        assert found.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


def test_every_query_is_listed():
    assert set(COLUMNS) == set(QUERIES)
