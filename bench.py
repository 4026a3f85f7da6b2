"""Headline jobs over a stored passage table; prints one JSON line.

The passage table is written once (timed as ``append_passages``), because the
jobs are meant to read stored days, not to derive them.  Every job runs once cold
and twice warm; ``queries`` holds the better warm time and ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import derived  # noqa: E402
from checks.payloads import nested_payloads  # noqa: E402
from wayside.operators import dedup, export, ingest, profiles, taxi, traffic  # noqa: E402
from wayside.plans import refresh, rewrite  # noqa: E402
from wayside.session import build_session, scratch_path  # noqa: E402
from wayside.sources.passages import append_passages, read_passages  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "wayside-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.wayside.localZone": "Europe/Brussels",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    table = scratch_path(spark, "bench-passages")
    start = time.time()
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(int(cpus))
    append_passages(derived.passages_of(lineitem), table)
    cold = {"append_passages": round(time.time() - start, 3)}

    passages = read_passages(spark, table)
    cameras, areas = derived.cameras(spark, sf_dir), derived.areas(spark, sf_dir)
    payloads, hours = scratch_path(spark, "bench-payloads"), scratch_path(spark, "bench-hours")
    nested_payloads(passages).repartition(int(cpus)).write.text(payloads)
    run_at = datetime(2000, 11, 1, 12)

    def backfill() -> None:
        path = scratch_path(spark, "bench-backfill")
        lookups = {"cameras": cameras}
        refresh.refresh(
            "heavy_hour", passages, lookups, path, date(2000, 11, 2), date(1999, 12, 31)
        )

    def make_hours() -> None:
        refresh.refresh("passage_hour", passages, {}, hours, date(2000, 11, 2), date(1999, 12, 31))

    make_hours()
    hour_table = refresh.read_table(spark, hours, "passage_hour")
    copies = passages.unionByName(passages)
    few_copies = passages.unionByName(passages.filter("pmod(xxhash64(passage_id), 100) = 0"))
    jobs = {
        "agg_heavy_v2": lambda: run(traffic.heavy_hour(passages, cameras)),
        "agg_heavy_minute": lambda: run(traffic.heavy_minute(passages, cameras)),
        "agg_heavy_v1": lambda: run(traffic.heavy_cordon_hour(passages, cameras)),
        "agg_igor_hour": lambda: run(traffic.igor_hour(passages, cameras)),
        "agg_passage_hour": lambda: run(traffic.passage_hour(passages)),
        "agg_taxi_hour": lambda: run(taxi.taxi_hour(passages, areas)),
        "minute_view": lambda: run(profiles.minute_counts(passages)),
        "vehicle_profile": lambda: run(profiles.vehicle_profile(passages)),
        "export_hourly": lambda: run(export.hourly_totals(hour_table, year=2000)),
        "dedup_passages": lambda: run(dedup.first_of_key(copies)),
        "duplicate_passages": lambda: run(dedup.later_copies(copies)),
        "dedup_few_copies": lambda: run(dedup.first_of_key(few_copies)),
        "duplicates_few_copies": lambda: run(dedup.later_copies(few_copies)),
        "ingest_v2": lambda: run(
            ingest.to_passages(ingest.read_validated(spark.read.text(payloads), "v2"), run_at)
        ),
        "bulk_privacy": lambda: rewrite.rewrite_history(
            spark, table, scratch_path(spark, "bench-masked")
        ),
        "backfill_heavy_v2": backfill,
    }
    warm = {}
    for name, job in jobs.items():
        times = []
        for _ in range(3):
            start = time.time()
            job()
            times.append(time.time() - start)
        cold[name] = round(times[0], 3)
        warm[name] = round(min(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_jobs_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "rows": passages.count(),
                "cpus": int(cpus),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
