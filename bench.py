"""Benchmark the headline queries.

Runs each query once over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line. Every query is executed in
full through the ``noop`` sink (no collect to the driver). The mapping to the
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# reference step -> registered query
HEADLINE = {
    "core_typing": "dedup_latest",            # raw -> core: type, classify, dedup
    "core_registration": "drive_class_counts",
    "meter_typing_gap": "gap_columns",        # meter typing + gap
    "dim_maker": "dim_maker",
    "dim_model": "dim_model",
    "dim_powertrain": "dim_powertrain",
    "fact_build": "fact_build",               # 4 joins
    "fact_row_check": "fact_row_check",
    "a1_powertrain_mix": "powertrain_mix",
    "a2_country_vs_all": "country_vs_all",
    "a3_fleet_target": "fleet_target",
    "a6_mass_trend": "mass_trend",
    "a4_gap_by_year": "gap_by_year",
    "a4_gap_pooled": "gap_pooled",
    "a5_rank_reversal": "rank_reversal",
    "a5c_pair_count": "reversal_pairs",
    "grid_hourly_intensity": "hourly_intensity",
    "wtw_scenarios": "wtw_scenarios",
    "completeness_cost": "completeness_cost",
    "maker_gap": "maker_gap",
    "credit_factor_median": "credit_factor_median",
    "raw_quality_missing": "unpivot_missing",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from gapmeter.catalog import QUERIES
    from gapmeter.session import build_session
    spark = build_session(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2)), "gapmeter-bench",
                          {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="gm-bench-ckpt-"),
                           "spark.driver.memory": "16g"})
    # warm-up of the JVM only (touches no pipeline layer, so every layer build
    # is timed inside the first headline query that needs it)
    QUERIES["half_open_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, q in HEADLINE.items():
        t0 = time.perf_counter()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
