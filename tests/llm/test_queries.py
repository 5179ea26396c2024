"""The registered queries: their names, columns and, where they have SQL, their rows."""

import pytest

from tallyhouse.llm.queries import ORACLE_SQL, QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_near_dedup": "doc_id class_id class_size",
    "op3_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_line_dedup": "doc_id n_lines n_removed removed",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_nearest": "query_id rank vec_id score",
    "op12_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_operators_are_registered():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLE_SQL) <= set(QUERIES)
    assert set(compare.entry.queries()) >= {*COLUMNS, "pipeline"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns == COLUMNS[name].split()
    of, n = ("query_id", 25) if name == "op11_nearest" else ("doc_id", 200)
    assert frame.select(of).distinct().count() == n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert compare.differences(spark, compare.oracle(SF), name, SF) is None
