"""A cross-section of the registered queries against their SQL text (all of them: tools/check.py)."""

import pytest
from check import table
from paths import SF

import __spark_entry__ as entry

KEYS = ["nrm_normalize", "nrm_decode_fixpoint", "nrm_html_unescape", "nrm_decode_variants", "req_query_parts", "req_merge_parts", "req_json_flatten", "req_multipart",
        "fea_statistical", "fea_nesting_depth", "fea_qps_slot", "sco_keyword", "sco_structural", "lab_rescue", "lab_virtual_patch", "lab_dynamic_rules", "agg_subset_metrics",
        "agg_recall_buckets", "agg_latency", "agg_miss_clusters", "set_dedupe", "set_carry_over", "smp_stratified_split", "aug_expand", "aug_unicode_escape", "win_source_buffer",
        "win_session_gap", "win_reward_avg", "ml_online_threshold", "jn_memory_knn", "jn_retrieve", "jn_policy_asof", "src_http1_log", "src_gsi_blocks", "snk_waf_rules",
        "str_windowed_stats", "str_session_bursts", "str_source_state", "str_adaptive_feedback", "exp_refine", "flagship"]


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[key])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 8
