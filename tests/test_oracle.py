"""Registered queries against their SQL on the smallest tables (a spread of them; the whole list
is checked by `python tests/oracle.py 0.01`)."""

import pytest

import __spark_entry__ as entry
from oracle import compare

NAMES = (
    "t3_lookup_key t6_lexical_signature m1_jaccard j4_tag_codes c17_corpus_selection a6_corpus_audit f4_candidate_decision w6_layered_fallback "
    "u1_batch_statuses u3_vector_upsert w2_round_robin jn3_nearest_in_time jn5_knn_exact a12_density_baseline a11_cluster_summary "
    "a17_divergence a14_source_summary l5_highlight_page a8_story_summary l2_story_page l10_review_batch a24_review_sweep st2_daily_coverage"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small, name):
    result = compare(spark, small, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result["ok"], result.get("why")
