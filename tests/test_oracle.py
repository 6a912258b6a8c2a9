"""Registered queries against their SQL at sf0.001.

A sample of each family by default; BARLEAF_ALL=1 runs every one.
tests/check.py does the same for any scale from the command line.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = """
features_returns features_volatility features_regime features_benchmark events_sentiment_decay events_filings macro_features attention_tone
rule_momentum_rotation rule_turtle_donchian rule_macd_crossover rule_quality_factor rule_hrp rule_thompson_sampling_rl evaluate_daily_results
io_jsonl_skip_corrupt merge_keyed_last pages_article_text quality_bar_checks decide_stance size_tiered_allocation rules_standing rules_cycles flags_composite
split_combinatorial metric_pooled_ic metric_drift ledger_calibration band_conformal nonlinear_perm_entropy_60 nonlinear_hill_tail_alpha_250 nonlinear_rough_vol_h_120 nonlinear_wavelet_hf_60 nonlinear_ar1_60 nonlinear_hist_entropy_60
gate_shuffled_labels features_assembled_prices_and_filings words_jaccard ledger_pending flags_overrides
words_near_copies_dropped search_tfidf live_latest_price live_equity_log term_interpolated
""".split()


def names():
    sql = entry.oracle_sql()
    return list(sql) if os.environ.get("BARLEAF_ALL") else [n for n in SAMPLE if n in sql]


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, name):
    r = compare(spark, duck(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert r["match"], r


def test_every_rule_is_registered():
    from barleaf.operators.rules import RULES

    queries = entry.queries()
    assert len(RULES) + 3 == 101
    assert all(f"rule_{n}" in queries for n in [*RULES, "buy_and_hold", "ma_crossover", "ml_ranker"])


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0
