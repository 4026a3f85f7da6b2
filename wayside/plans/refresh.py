"""Aggregate tables, replaced day by day.

A table is Parquet partitioned by the day of its bucket.  A refresh computes all
its days in one job, replaces exactly those days and clears the ones that came
out empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayside.operators import taxi, traffic
from wayside.operators.filters import in_local_days, in_utc_days
from wayside.schemas import AGGREGATES
from wayside.sources import passages as stored
from wayside.sources.passages import laid_out


@dataclass(frozen=True)
class Job:
    """How one aggregate table is made from the passages of its days."""

    build: Callable[..., DataFrame]
    lookups: tuple[str, ...]
    local_days: bool
    day_column: str
    trailing_days: int
    sort: tuple[str, ...]


# Bucket zone, days redone by default and sort order per table.
JOBS = {
    "passage_hour": Job(
        traffic.passage_hour, (), False, "date", 1, ("camera_id", "hour")
    ),
    "heavy_cordon_hour": Job(
        traffic.heavy_cordon_hour, ("cameras",), False, "passage_at_date", 3, ("passage_at_hour",)
    ),
    "heavy_hour": Job(
        traffic.heavy_hour,
        ("cameras",),
        True,
        "passage_at_date",
        1,
        ("camera_id", "rijrichting", "passage_at_hour"),
    ),
    "heavy_minute": Job(
        traffic.heavy_minute,
        ("cameras",),
        True,
        "passage_at_date",
        1,
        (
            "camera_id",
            "rijrichting",
            "passage_at_hour",
            "passage_at_minute",
            "kenteken_hash",
        ),
    ),
    "igor_hour": Job(
        traffic.igor_hour, ("cameras",), False, "passage_at_date", 3, ("passage_at_hour",)
    ),
    "taxi_hour": Job(
        taxi.taxi_hour,
        ("areas",),
        False,
        "passage_at_date",
        3,
        ("gebiedstype", "gebied", "hh", "electric"),
    ),
}


def run_days(job: Job, today: date, from_day: date | None = None) -> tuple[date, date]:
    """First and last day of a run: from ``from_day``, else the trailing days of
    the job, up to yesterday."""
    return from_day or today - timedelta(days=job.trailing_days), today - timedelta(days=1)


def _chosen(job: Job, passages: DataFrame, first: date, last: date) -> DataFrame:
    return (in_local_days if job.local_days else in_utc_days)(passages, first, last)


def aggregate_days(
    job: Job, passages: DataFrame, lookups: dict[str, DataFrame], first: date, last: date
) -> DataFrame:
    chosen = _chosen(job, passages, first, last)
    return job.build(chosen, *[lookups[name] for name in job.lookups])


def has_many_rows(passages: DataFrame) -> bool:
    """Whether the passages are so many that, were they all groups of their own, the tasks
    of a shuffle would have enough of every day for a file.  Where they are fewer groups,
    they also go to fewer tasks."""
    tasks = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = passages.groupBy(F.to_date("passage_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    found = days.agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows")).first()
    return found["days"] > 0 and found["rows"] >= stored.OWN_FILE_ROWS * found["days"] * tasks


def _days_with_rows(
    spark: SparkSession, path: str, day_column: str, first: date, last: date
) -> set[date]:
    """Days that hold rows.  Only the folder names and file footers are read."""
    held = spark.read.schema(f"{day_column} date").parquet(path)
    days = held.filter(F.col(day_column).between(F.lit(first), F.lit(last))).distinct()
    return {row[0] for row in days.collect()}


@dataclass(frozen=True)
class Refreshed:
    written: list[date]
    cleared: list[date]
    rows: int


def replace_days(
    result: DataFrame,
    path: str,
    day_column: str,
    first: date,
    last: date,
    sort: tuple[str, ...] = (),
    gather: bool = True,
) -> Refreshed:
    """Make the days first … last of the table equal to ``result``.

    Rows of other days are an error and touch no other day: they are counted and
    left out before anything is written.  Days with rows are staged and swapped in
    by one dynamic overwrite when the job commits.  That leaves days without rows as they were, so the ones that
    still hold old rows are overwritten with an empty file afterwards.  A run
    that failed half-way is repaired by running it again.

    Without ``gather`` every task writes its own file of each day.
    """
    spark = result.sparkSession
    seen = Observation()
    # The rows of one day are already spread by their keys; several days are
    # gathered first, so that each gets few files, unless tasks have many rows of each.
    inside = F.col(day_column).between(F.lit(first), F.lit(last))
    watched = result.observe(
        seen,
        F.collect_set(F.when(inside, F.col(day_column))).alias("days"),
        F.count_if(inside).alias("rows"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("stray"),
    )
    own = watched.filter(inside)
    gathered = gather and first < last
    rows = laid_out(own, day_column, *sort) if gathered else own.sortWithinPartitions(
        day_column, *sort
    )
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day_column)
        .parquet(path)
    )
    written = set(seen.get["days"])
    stale = _days_with_rows(spark, path, day_column, first, last) - written
    schema = result.drop(day_column).schema
    for day in sorted(stale):
        empty = spark.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(f"{path}/{day_column}={day.isoformat()}")
    if seen.get["stray"]:
        raise ValueError(f"{seen.get['stray']} rows outside the days of the run were left out")
    return Refreshed(sorted(written), sorted(stale), seen.get["rows"])


def refresh(
    name: str,
    passages: DataFrame,
    lookups: dict[str, DataFrame],
    path: str,
    today: date,
    from_day: date | None = None,
) -> Refreshed | None:
    """Trailing refresh, or with ``from_day`` a backfill, of one table."""
    job = JOBS[name]
    first, last = run_days(job, today, from_day)
    if first > last:
        return None
    result = aggregate_days(job, passages, lookups, first, last)
    declared = [(f.name, f.dataType) for f in AGGREGATES[name]]
    if [(f.name, f.dataType) for f in result.schema] != declared:
        raise TypeError(f"{name} does not have its declared columns")
    gather = first < last and not has_many_rows(_chosen(job, passages, first, last))
    return replace_days(result, path, job.day_column, first, last, job.sort, gather)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The stored aggregate ``name`` with its declared columns."""
    schema = AGGREGATES[name]
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
