"""Answers that need not read the whole passage table.

The newest page reads day folders from the newest backwards until it is full.  How new
the table is, its span and its size come from the log of its batches; a table without a
log is scanned.  A table that has a log must be added to by batches alone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.operators import profiles, quality
from wayside.operators.filters import PAGE_SIZE, by_attributes, newest
from wayside.schemas import PASSAGE_DAY
from wayside.sources.batches import Log, read_log
from wayside.sources.passages import read_days, read_passages, stored_days


def newest_page(
    spark: SparkSession, table: str, size: int = PAGE_SIZE, after: dict | None = None, **criteria
) -> DataFrame:
    """One page of passages that meet the criteria, newest first.

    ``after`` holds the key of the last row of the page before.  Days are taken from the
    newest backwards; with the log's counts, and without criteria, at once as many as the
    page needs.  Otherwise their number doubles until the page is full, so a rare value
    is looked for in all days at the end.
    """
    days = stored_days(spark, table)[::-1]
    log = read_log(spark, table)
    if after:
        days = [day for day in days if day <= after["passage_at"].date()]
    take, certain = 1, False
    if log and not criteria:
        # Rows of the day of ``after`` may stand before it, so they are not counted on.
        counts = [0 if after and n == 0 else log.days.get(day, 0) for n, day in enumerate(days)]
        while take < len(days) and sum(counts[:take]) < size:
            take += 1
        certain = True
    while True:
        rows = by_attributes(read_days(spark, table, days[:take]), **criteria)
        page = newest(rows, size, after)
        if certain or take >= len(days) or page.count() == size:
            return page
        take *= 2


# -------------------------------------------------------------------- from the log


def _stamps(spark: SparkSession, log: Log) -> DataFrame:
    """Rows with the log's newest ingest time and its first and last passage."""
    rows = [(log.newest, log.first), (log.newest, log.last)] if log.rows else []
    return spark.createDataFrame(rows, "created_at timestamp_ntz, passage_at timestamp_ntz")


def freshness(spark: SparkSession, table: str, now: datetime) -> DataFrame:
    log = read_log(spark, table)
    return quality.freshness(_stamps(spark, log) if log else read_passages(spark, table), now)


def day_span(spark: SparkSession, table: str) -> DataFrame:
    log = read_log(spark, table)
    return profiles.day_span(_stamps(spark, log) if log else read_passages(spark, table))


def rows_per_day(spark: SparkSession, table: str) -> DataFrame:
    log = read_log(spark, table)
    if not log:
        return profiles.rows_per_day(read_passages(spark, table))
    return spark.createDataFrame(list(log.days.items()), f"{PASSAGE_DAY} date, count long")


def volume(spark: SparkSession, table: str, floor: int = quality.MIN_ROWS) -> DataFrame:
    total = rows_per_day(spark, table).agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("row_count")
    )
    return total.select("row_count", (F.col("row_count") >= floor).alias("enough"))


def missing_days(spark: SparkSession, table: str, first: date, last: date) -> DataFrame:
    log = read_log(spark, table)
    days = rows_per_day(spark, table) if log else read_passages(spark, table)
    return quality.missing_days(days, first, last)
