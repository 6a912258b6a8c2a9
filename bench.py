"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS set the input and
the cores.  ``stage_features`` is the cost of building the feature table that
the rule queries read; it is timed once and counted in the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barleaf.plans.catalog import QUERIES
from barleaf.plans.price_queries import features
from barleaf.session import local_session

HEADLINE = [
    "quality_bar_checks", "merge_keyed_last", "io_partitioned_year",
    "events_filings", "attention_tone", "macro_on_panel", "rule_momentum_rotation", "rule_macd_crossover",
    "rule_multi_factor_5", "rule_turtle_donchian", "rule_cross_sectional_rankz", "evaluate_momentum_rotation", "evaluate_attribution",
    "size_cap_redistribute", "metric_pooled_ic", "metric_drift", "ledger_resolve", "band_quantiles", "rules_compliance",
    "nonlinear_perm_entropy_60", "nonlinear_rough_vol_h_120", "words_near_copies_dropped", "search_tfidf", "search_embedding", "model_walk_forward",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINE
    took = {}
    start = time.time()
    features(spark, folder).count()
    took["stage_features"] = round(time.time() - start, 3)
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
