"""The batch chain as plain functions.

``run_chain`` writes every layer and mart of one input folder: sources ->
core -> star -> marts, with the empty-input guard between steps and all
quality findings appended to one findings table. Each step is one Spark job
graph; there is no scheduler -- the order of the calls is the order of the
steps, and a failing step stops the chain (as ON_ERROR_STOP does).
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from ..operators import quality as Q
from ..sources import load as L


def run_chain(spark: SparkSession, sf_dir: str, out_dir: str, marts: list[str] | None = None) -> dict[str, float]:
    """Write core, star and the listed marts (default: all analyses) as Parquet
    tables under ``out_dir``; returns seconds per step."""
    from .. import catalog as C
    from ..plans import star as ST
    from ..registry import q_quality as QQ

    times: dict[str, float] = {}

    def step(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    out = out_dir.rstrip("/")
    step("raw", lambda: L.write_mart(L.require_rows(C.raw(spark, sf_dir), "raw registrations"), f"{out}/raw"))
    step("core_registration", lambda: L.write_mart(C.reg(spark, sf_dir), f"{out}/core_registration"))
    step("core_realworld", lambda: L.write_mart(L.require_rows(C.rw(spark, sf_dir), "meter data"),
                                                f"{out}/core_realworld"))
    step("findings", lambda: L.append_findings(
        Q.union_all(QQ._raw_findings(spark, sf_dir) + QQ._core_findings(spark, sf_dir)),
        f"{out}/dq_befund", truncate=True))
    step("star_fact", lambda: ST.write_fact(C.star_fact(spark, sf_dir), f"{out}/fact_registration"))
    for dim in ("manufacturer", "model", "powertrain", "country"):
        step(f"dim_{dim}", lambda dim=dim: L.write_mart(C.star_dim(spark, sf_dir, dim), f"{out}/dim_{dim}"))
    names = marts or ["powertrain_mix", "country_vs_all", "fleet_target", "mass_trend", "gap_by_year",
                      "gap_pooled", "rank_reversal", "hourly_intensity", "wtw_scenarios", "maker_gap",
                      "maker_gap_plugin", "mix_effect"]
    for n in names:
        step(n, lambda n=n: L.write_mart(C.QUERIES[n](spark, sf_dir), f"{out}/mart_{n}"))
    return times
