"""Every query with SQL against that SQL, and the contracts' columns."""

import pytest

from checks.run import compare, connect
from pkgrisk.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


COLUMNS = {
    "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op4_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op13_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    ids = [r[0] for r in df.select("doc_id").collect()]
    assert sorted(ids) == [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
