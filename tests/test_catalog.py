"""Registered queries against their SQL check on the small data.

By default one key of each kind of plan runs; TABLOOM_ALL=1 runs the whole
catalog (``python -m tests.oracle sf0.01`` does so outside pytest).
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

ROOT = "/root/testdata/sf0.001"
DEFAULT = """claims_flat_insert claims_mint_ids claims_care_flags scan_fixed_width sink_truncate_reload incremental_file_ingest
conform_to_schema drop_dups_subset fill_nulls join_any_of_columns join_event_interval anti_theta agg_describe agg_string_join agg_mode
win_running_total win_ffill_max_id win_merge_intervals win_rolling_mean top_percent union_outer_columns str_token_match date_next_run
arr_sort_struct wellness_flags_v2 wellness_actions enroll_candidates provider_scd catchment_zips facility_cluster conversion_metrics
member_features corr_kendall outliers_iqr eval_roc_auc eval_decile_table label_encode clf_knn text_vote_words series_features""".split()
KEYS = sorted(entry.queries()) if os.environ.get("TABLOOM_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    got = compare(spark, con, key, entry.queries()[key], entry.oracle_sql().get(key), ROOT)
    assert got.startswith(("ok", "rows-only")), got


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
