"""Physical plans: pruning, pushed filters, rank limits before the shuffle, no joins of all pairs, no Python."""

import os
import re

import pytest

from tessella.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "left_semi_valid")
    assert "EqualTo(quality,1)" in text
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("source" in r for r in read) and not any("text" in r for r in read)
    assert "LessThanOrEqual(l_shipdate" in plan(spark, "priced_summary")


def test_rank_limits_come_before_the_shuffle(spark):
    text = plan(spark, "per_group_cap")
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")  # the partial one is below the exchange


def test_first_seen_is_a_partial_aggregate(spark):
    assert "partial_min" in plan(spark, "exact_text_dedupe_first_seen") and "Window" not in plan(spark, "exact_text_dedupe_first_seen")


@pytest.mark.parametrize("name", ["cosine_pairwise_stats", "contamination_ngram_jaccard", "nearest_step_lookup", "lexicon_coverage", "term_containment_join"])
def test_no_joins_of_all_pairs(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["manifest_gate_funnel", "char_class_ratios", "cer_pairs_micro_macro", "lang_budget_mix", "cosine_top1", "sentence_split_pool"])
def test_no_python_in_built_in_queries(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", ["stride_sample", "shard_assign", "hash_split_80_10_10", "round_robin_source_budget", "lang_budget_mix"])
def test_global_orders_sort_within_buckets(spark, name):
    """Only bucket totals may meet in one partition; every window over rows is by bucket."""
    for window in re.findall(r"Window \[.*", plan(spark, name)):
        assert "_bucket" in window
