"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of parquet files, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import time

from habitus.session import build_session
from workload import registry

HEADLINE = (
    "scan_files", "collect_evidence", "code_sample", "layer_file_plan", "layer_samples",
    "sections", "rule_texts", "trace_rules", "verify", "trace_diff", "select_top_rules",
    "upsert_catalog", "run_and_phase_metrics", "partition_speculative", "complete",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cores": int(cpus),
                "spark": spark.version,
                "shuffle_partitions": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
