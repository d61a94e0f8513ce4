"""Every llm query over the test data: against its SQL twin, or one row for each of the table's."""

import comparing
import pytest
from murmur.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"
ROWS = {"op3_html_extraction": 250, "op4_minhash_near_dedup": 1000, "op5_bpe_round_trip": 1000, "op6_token_files": 1000,
        "op9_language_id": 1000, "op10_sharding": 1000}
COLUMNS = {
    "op2_url_filters": {"page_id", "host", "path", "rule", "verdict"}, "op3_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op4_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_bpe_round_trip": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.fixture(scope="module")
def duck():
    return comparing.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    assert comparing.types_differ(result, duck, ORACLES[name]) == {}
    got, want = comparing.spark_table(result), comparing.duck_table(duck, ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_all_rows(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    assert COLUMNS.get(name, set()) <= set(result.columns)
    assert result.count() == ROWS.get(name, result.count()) > 0
