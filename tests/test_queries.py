"""A query of each family in both engines; the driver compares all of them."""

import pytest

from eventclock import catalog

NAMES = [
    "axis_dollar", "axis_tick", "axis_imbalance", "axis_dc", "axis_zcusum", "axis_jump", "axis_chl", "axis_sess2", "axis_gapflow", "axis_permclock", "axis_mpnov",
    "feat_momentum", "feat_rolling", "feat_calendar", "feat_ddstate", "feat_regime", "label_tertile", "label_ker", "label_trend_scan", "label_perment",
    "size_cdf_overlay", "size_cond_es", "size_aim", "size_executed", "perf_score", "perf_drawdown", "perf_evalue", "stat_holm", "stat_bh", "stat_lond", "stat_dsr",
    "axis_entropy", "axis_fracdiff", "axis_run", "axis_kalman", "axis_newma", "axis_pecusum", "feat_sample_entropy", "feat_evt", "label_triple_barrier", "label_dp_oracle", "label_trend_leg",
    "label_visgraph", "label_tlb_reversal", "label_sadf_explosive", "label_survival_bounds", "book_replay", "book_years", "book_hold_metrics", "book_derived", "perf_older_score_overlay",
    "stat_pbo", "stat_screen_rollup", "join_ingest", "calibrate_isotonic", "calibrate_venn_abers", "reduce_mrmr", "reduce_pls", "model_scaler", "stat_kaplan_meier", "join_asof", "join_asof_lag", "join_ensemble", "model_auc", "model_masks",
]


@pytest.mark.parametrize("name", NAMES)
def test_engines_agree(agree, name):
    agree(catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_check_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
