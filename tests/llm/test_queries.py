"""Every query of the subpackage over the smallest tables: its SQL where it has one, its contract's columns, all rows."""

import os

import pytest

from millrace.llm import queries
from tests.test_queries import FOLDER, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = {
    "op1_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_sentencepiece_nbest": ["doc_id", "ids", "scores", "others", "round_trip"],
    "op3_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op4_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_quality_cotraining": ["doc_id", "text_score", "meta_score", "score", "toxicity", "toxic", "kept"],
    "op6_line_dedup": ["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"],
    "op7_benchmark_decontamination": ["doc_id", "item_id", "n_item", "n_shared"],
    "op8_paragraph_dedup": ["doc_id", "n_paragraphs", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"],
    "op9_ppm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
    "op10_license_scan": ["doc_id", "licences", "sentences", "span_starts", "span_ends", "n_unknown"],
    "op11_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_word_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped"],
}
#: Queries whose rows are not those of the table.
FEWER = {"op7_benchmark_decontamination", "op10_license_scan", "op12_filter_audit"}


def test_every_query_is_listed():
    assert list(queries.queries()) == list(COLUMNS) and set(queries.oracle_sql()) < set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, duck, name):  # noqa: F811
    frame = queries.queries()[name](spark, FOLDER)
    assert frame.columns == COLUMNS[name]
    rows = frame.collect()
    if name not in FEWER:
        table = "embeddings" if name.startswith("op4") else "documents"
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    sql = queries.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        there = [c[0] for c in result.description]
        assert sorted(there) == sorted(COLUMNS[name])
        names = sorted(there)
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[there.index(c)]) for c in names) for r in result.fetchall())
