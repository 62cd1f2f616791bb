"""Registered queries against their SQL on the smallest tables; the driver checks all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "inverted_index", "expanded_queries", "keyword_search", "name_search", "lookup_longest", "vector_topk", "rule_labels",
    "display_names", "formatted_titles", "classified_intent", "consensus_cards_by_name", "best_item", "phase_counts",
    "route_by_rules", "route_by_score", "evidence", "unique_slugs", "ttl_cache_hits", "debounced_events",
]


def test_contract():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


def test_entry(spark):
    assert entry(spark).columns == ["qid", "id", "score", "rank"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    result, _, _, _ = compare(spark, connect(SF), name, queries()[name], oracle_sql()[name], SF)
    assert result == "ok"
