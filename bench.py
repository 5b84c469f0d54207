"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (all rows computed, none
collected) after one warm-up of the session.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cgm_gap_fill",
    "cgm_person_fill",
    "cgm_multi_column",
    "bgm_clean",
    "insulin_metadata",
    "carbs_clean",
    "notes_clean",
    "align_all",
    "timeline_check",
    "resample_daily_sum",
    "month_stats",
    "ts_convert",
    "ts_all_formats",
    "csv_source",
    "sqlite_source",
    "json_source",
    "xml_source",
    "conformance_report",
    "export_complete",
    "export_months",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("GLUCOFLOW_MASTER", f"local[{cpus}]")
    from glucoflow.plans.queries import QUERIES
    from glucoflow.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", partitions=max(8, cpus * 2))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM, parquet footers, codegen caches
    try:
        QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001 - the timed loop reports it
        print(f"warm-up failed: {e!r}"[:500], file=sys.stderr)
    times: dict[str, float | None] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - keep the one-line report
            print(f"{name} failed: {e!r}"[:500], file=sys.stderr)
            times[name] = None
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(t for t in times.values() if t is not None), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
