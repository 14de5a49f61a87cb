"""Registered queries against their SQL, and their columns."""

import pytest
from compare import connect, differences

from llm.cases import SF_DIR
from numberboard.llm.registry import QUERIES

COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "n_words", "log_score"],
    "op9": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10": ["doc_id", "contaminated", "item_ids", "best_share"],
    "op11": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13": ["page_id", "url", "text", "n_chars"],
}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    query, sql = QUERIES[name]
    assert differences(query(spark, SF_DIR), connect(SF_DIR), sql) is None


@pytest.mark.parametrize("name", ["op2_ftrl_language", "op5_discriminant_quality", "op9_online_packing"])
def test_columns(spark, name):
    columns = QUERIES[name][0](spark, SF_DIR).columns
    assert [c for c in columns if c in COLUMNS[name.split("_")[0]]] == COLUMNS[name.split("_")[0]]


def test_every_operator_has_one_query():
    assert sorted(COLUMNS) == sorted(n.split("_")[0] for n in QUERIES)
