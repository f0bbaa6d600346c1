"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetlens.plans import derived
from fleetlens.plans.queries import StoredInputs, runner
from fleetlens.session import local_session

HEADLINE = (
    "api_inventory", "union_signals", "sql_tables", "provenance_rank", "capability_signals", "declared_dependencies",
    "env_inventory", "important_files", "pii_scan", "personal_emails", "deletion_candidates", "orphan_by_mention",
    "fingerprint", "health_facts", "debt_ranking", "repo_card", "claims_minus_evidence", "merge_blocks",
    "citation_check", "leak_check", "sweep_selection", "stream_change_gate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("fleetlens-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    start = time.perf_counter()
    derived.tracked(spark, folder).count()
    timings["land_corpus"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    StoredInputs(spark, folder).evidence.signals().count()
    timings["land_evidence"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    StoredInputs(spark, folder).mentions.table("units").count()
    timings["land_mentions"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
