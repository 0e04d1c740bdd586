"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Every query runs whole, its result discarded by a ``noop`` write. An untimed
round over all queries warms up the JVM; of the timed rounds the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tradespec.session import build_session  # noqa: E402
from verification.registry import QUERIES  # noqa: E402

HEADLINE = (
    "dom1_entity_rca",
    "dom2_selection_rca_one_state",
    "dom2_selection_rca_several_states",
    "dom12_comparison_table",
    "dom13_legacy_comparison_table",
    "dom15_lump_small_shares",
    "dom17_bridge_rollup",
    "dom19_headline_numbers",
    "dom20_three_source_table",
    "ag4_country_rca",
    "ag6_country_year_summary",
    "ag9_heading_shares",
    "ag15_exports_by_code_and_year",
    "ag17_cube",
    "ag20_aggregate_by",
    "flt5_membership",
    "flt11_record_filter",
    "src1_exports_csv",
    "src9_payload_rows",
    "jn6_attach_descriptions",
    "jn7_three_key_join",
    "top1_top_products",
    "sc1_money_text",
)
TIMED_ROUNDS = 2


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            # Skips recording the Python call site of every column expression.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rounds = [
        {name: run(name, spark, folder) for name in HEADLINE}
        for _ in range(1 + TIMED_ROUNDS)
    ]
    seconds = {
        name: round(min(timed[name] for timed in rounds[1:]), 3) for name in HEADLINE
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("/sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
