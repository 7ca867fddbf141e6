"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is built and fully executed into the ``noop`` sink; the time covers both.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lendlens.checks import run_check  # noqa: E402
from lendlens.session import local_session, scratch_scope  # noqa: E402

HEADLINE = [
    "l1_silver_customers", "l1_silver_deals", "l1_silver_facilities", "l1_silver_pricing_cases", "l1_silver_risk_assessments",
    "l1_silver_relationship_snapshots", "l3_facility_economics", "l5_rm_dashboard", "l2_gold_deal_economics", "w2_final_quote", "w8_percent_rank",
    "w12_priority_rank", "a7_deal_features", "a12_win_rate_cuts", "a14_trimmed_correlation", "a16_acceptance_by_rate", "p6_quantile_trim",
    "q1_profile", "q5_silver_summary", "m7_train_pipeline", "m11_roc_auc", "m13_decile_lift", "o1_acceptance_model", "o5_posterior_predictive",
    "o12_profit_price", "g2_win_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus), app="lendlens-bench")
    run_check("s3_load_table", spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's readers
    times = {}
    for key in wanted:
        start = time.perf_counter()
        with scratch_scope(spark):
            # the bench tables are files of a single row group
            run_check(key, spark, folder, spread=int(cpus)).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
