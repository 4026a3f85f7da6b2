"""Command line for scheduled runs: ``python -m wayside.jobs <job> …``.

Every path is a folder all executors can reach.  ``--today`` and ``--now``
default to the clock; give them to repeat a run.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.calendar import ZONE_SETTING
from wayside.operators.export import camera_delivery, hourly_totals
from wayside.plans import answers
from wayside.plans.ingest import ingest_batch
from wayside.plans.refresh import JOBS, read_table, refresh
from wayside.plans.rewrite import compact_table, mask_table
from wayside.session import build_session
from wayside.sources.passages import read_passages
from wayside.sources.payloads import stream_payloads
from wayside.sources.reference_data import (
    load_cameras,
    load_taxi_areas,
    read_helper,
    replace_table,
)
from wayside.sources.sinks import write_delivery_csv, write_hourly_csv
from wayside.streaming.ingest import start_ingest


def _ingest(spark: SparkSession, args) -> str:
    places = (args.passages, args.invalid, args.duplicates)
    given = {"v1": args.v1, "v2": args.v2}
    paths = {version: path for version, path in given.items() if path}
    if not paths:
        raise SystemExit("give the payloads of at least one version: --v1, --v2")
    if args.checkpoint:
        streams = {version: stream_payloads(spark, path) for version, path in paths.items()}
        start_ingest(streams, *places, args.checkpoint, args.now, wait=args.wait).awaitTermination()
        return "ingest finished"
    if not args.batch:
        raise SystemExit("give the batch a label of its own: --batch")
    lines = {version: spark.read.text(path) for version, path in paths.items()}
    new = ingest_batch(lines, *places, batch=args.batch, now=args.now, wait=args.wait)
    return "ingest finished" if new else f"batch {args.batch} was finished before"


def _lookup(spark: SparkSession, args, name: str) -> DataFrame:
    """The helper table loaded last, or the one in a CSV file given for this run."""
    path = getattr(args, name)
    if path:
        return {"cameras": load_cameras, "areas": load_taxi_areas}[name](spark, path)
    if not args.helpers:
        raise SystemExit(f"give --helpers, the folder of the loaded tables, or --{name}")
    return read_helper(spark, {"cameras": "cameras", "areas": "taxi_areas"}[name], args.helpers)


def _refresh(spark: SparkSession, args) -> str:
    lookups = {name: _lookup(spark, args, name) for name in JOBS[args.table].lookups}
    done = refresh(
        args.table,
        read_passages(spark, args.passages),
        lookups,
        args.output,
        args.today,
        args.from_date,
    )
    return "no days to do" if done is None else f"{done.rows} rows, cleared {len(done.cleared)} days"


def _rewrite(spark: SparkSession, args) -> str:
    mask_table(spark, args.passages, args.wait)
    return f"{args.passages} is masked"


def _compact(spark: SparkSession, args) -> str:
    compact_table(spark, args.passages, args.wait)
    return f"{args.passages} is packed"


def _load(spark: SparkSession, args) -> str:
    reader = {"cameras": load_cameras, "taxi_areas": load_taxi_areas}[args.table]
    rows = replace_table(reader(spark, args.csv), args.table, args.helpers, args.wait)
    return f"{rows} rows"


def _export(spark: SparkSession, args) -> str:
    hours = read_table(spark, args.hours, "passage_hour")
    totals = hourly_totals(hours, args.today, args.year, args.week)
    return f"{write_hourly_csv(totals, args.output)} rows"


def _deliver(spark: SparkSession, args) -> str:
    passages = read_passages(spark, args.passages, args.first, args.last)
    write_delivery_csv(camera_delivery(passages, args.camera, args.first, args.last), args.output)
    return f"delivery in {args.output}"


def _check(spark: SparkSession, args) -> str:
    now = args.now or datetime.now(timezone.utc).replace(tzinfo=None)
    state = answers.freshness(spark, args.passages, now).first()
    rows = answers.volume(spark, args.passages).first()
    problems = [f"newest passage: {state.status}"] if state.status != "ok" else []
    problems += [] if rows.enough else [f"only {rows.row_count} rows"]
    if args.first:
        gaps = answers.missing_days(spark, args.passages, args.first, args.last or args.today)
        missing = gaps.agg(F.count(F.lit(1))).first()[0]
        problems += [f"{missing} days without passages"] if missing else []
    if problems:
        raise SystemExit("; ".join(problems))
    return "ok"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayside.jobs")
    day = date.fromisoformat
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name, run, *paths):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        sub.add_argument("--zone", required=True, help="IANA name of the roadside's time zone")
        sub.add_argument("--today", type=day)
        sub.add_argument("--now", type=datetime.fromisoformat)
        sub.add_argument(
            "--wait", type=float, default=0, help="seconds to wait for a run that writes the same"
        )
        return sub

    sub = job("ingest", _ingest, "passages", "invalid", "duplicates")
    sub.add_argument("--v1", help="flat payloads")
    sub.add_argument("--v2", help="nested payloads")
    sub.add_argument("--checkpoint", help="read the payload folder as a stream")
    sub.add_argument("--batch", help="label of a batch run; stands for its content")
    sub = job("refresh", _refresh, "passages", "output")
    sub.add_argument("--table", choices=sorted(JOBS), required=True)
    sub.add_argument("--helpers", help="folder that the job load fills")
    sub.add_argument("--cameras", help="CSV file to use instead of the loaded table")
    sub.add_argument("--areas", help="CSV file to use instead of the loaded table")
    sub.add_argument("--from-date", type=day)
    job("rewrite-history", _rewrite, "passages")
    job("compact", _compact, "passages")
    sub = job("load", _load, "csv", "helpers")
    sub.add_argument("--table", choices=["cameras", "taxi_areas"], required=True)
    sub = job("export", _export, "hours", "output")
    sub.add_argument("--year", type=int)
    sub.add_argument("--week", type=int)
    sub = job("deliver", _deliver, "passages", "output")
    sub.add_argument("--camera", action="append", required=True)
    sub.add_argument("--first", type=day, required=True)
    sub.add_argument("--last", type=day, required=True)
    sub = job("check", _check, "passages")
    sub.add_argument("--first", type=day)
    sub.add_argument("--last", type=day)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    args.today = args.today or datetime.now(ZoneInfo(args.zone)).date()
    spark = spark or build_session(f"wayside {args.job}")
    spark.conf.set(ZONE_SETTING, args.zone)
    return args.run(spark, args)


if __name__ == "__main__":
    print(main())
