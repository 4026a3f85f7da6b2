"""The stored passage table: Parquet, one folder per UTC day."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.schemas import PASSAGE, PASSAGE_DAY
from wayside.sources.files import PACKED, names_in, path_exists
from wayside.sources.generations import current_folder

STORED = T.StructType([*PASSAGE.fields, T.StructField(PASSAGE_DAY, T.DateType())])


def with_day(passages: DataFrame) -> DataFrame:
    return passages.withColumn(PASSAGE_DAY, F.to_date("passage_at"))


def read_passages(
    spark: SparkSession, path: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """The table, or its UTC days first … last (pruned on the folder name).

    The frame keeps to the generation of the table that was there when it was made.
    """
    passages = spark.read.schema(STORED).parquet(current_folder(spark, path))
    if first is not None:
        passages = passages.filter(F.col(PASSAGE_DAY) >= F.lit(first))
    if last is not None:
        passages = passages.filter(F.col(PASSAGE_DAY) <= F.lit(last))
    return passages


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days that have a folder, oldest first; only names are read."""
    prefix = f"{PASSAGE_DAY}="
    names = names_in(spark, current_folder(spark, path))
    return sorted(date.fromisoformat(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def read_days(spark: SparkSession, path: str, days: Iterable[date]) -> DataFrame:
    """The given days; no folder of another day is looked at."""
    folder = current_folder(spark, path)
    places = [f"{folder}/{PASSAGE_DAY}={day.isoformat()}" for day in sorted(set(days))]
    there = [place for place in places if path_exists(spark, place)]
    if not there:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", folder).parquet(*there)


def laid_out(df: DataFrame, day_column: str, *sort: str) -> DataFrame:
    """Rows gathered per day and sorted, ready for a day-partitioned write.

    The rebalance hint lets AQE split a day that holds a large part of the rows
    and merge small ones; the sort makes file statistics useful.
    """
    return df.hint("rebalance", F.col(day_column)).sortWithinPartitions(day_column, *sort)


# Rows that a task should have of each of its days, for these to be files of their own, rows
# that one task may sort and write, and rows that it sorts without spilling.
OWN_FILE_ROWS, OWN_TASK_ROWS, OWN_SORT_ROWS = 20_000, 8_000_000, 400_000

# Bytes of files that a task reads at most, and the least that this is lowered to.
_PART_BYTES, _LEAST_PART = "spark.sql.files.maxPartitionBytes", 1 << 20


def _parts(df: DataFrame, day_column: str) -> tuple[int, int, int]:
    """Days summed over tasks, rows, and rows of the largest task.  Computes the days of all
    rows."""
    parts = df.groupBy(F.spark_partition_id().alias("_task"), day_column).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    tasks = parts.groupBy("_task").agg(F.count(F.lit(1)).alias("_files"), F.sum("_rows").alias("_rows"))
    found = tasks.agg(
        F.sum("_files").alias("files"), F.sum("_rows").alias("rows"), F.max("_rows").alias("most")
    ).first()
    return found["files"] or 0, found["rows"] or 0, found["most"] or 0


def _large(files: int, rows: int, most: int) -> bool:
    return 0 < files and most <= OWN_TASK_ROWS and rows >= OWN_FILE_ROWS * files


def has_large_parts(df: DataFrame, day_column: str) -> bool:
    """Whether the tasks have so many rows of each of their days, and none has too many in
    all, that they may write them as they are."""
    return _large(*_parts(df, day_column))


def ready_to_add(passages: DataFrame, gather: bool | None = None) -> DataFrame:
    """Passages with their day, sorted for a day-partitioned write.

    Where every task has many rows of its days, each writes its own file per day, and no
    row is shuffled.  Otherwise, as for a small batch, the rows are gathered first.
    ``gather`` says so beforehand, for rows that are dear to compute.
    """
    rows, sort = with_day(passages), ("camera_naam", "passage_at")
    if gather or (gather is None and not has_large_parts(rows, PASSAGE_DAY)):
        return laid_out(rows, PASSAGE_DAY, *sort)
    return rows.sortWithinPartitions(PASSAGE_DAY, *sort)


def _bytes(text: str) -> int:
    found = text.strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(found[-1:], 1)
    return int(found.rstrip("kmg")) * unit


@contextmanager
def adding(passages: DataFrame, gather: bool | None = None) -> Iterator[DataFrame]:
    """``ready_to_add`` for a write in this block.

    Tasks that write what they read sort it first.  Where one would have too many rows to
    sort in memory, files are read in smaller parts while the block lasts: as small as
    leaves the tasks enough rows a file.
    """
    if gather is not None:
        yield ready_to_add(passages, gather)
        return
    conf, rows = passages.sparkSession.conf, with_day(passages)
    given = conf.get(_PART_BYTES)
    size = _bytes(given)
    try:
        files, total, most = _parts(rows, PASSAGE_DAY)
        for _ in range(3):
            smaller = max(_LEAST_PART, size * OWN_SORT_ROWS // max(most, 1))
            if most <= OWN_SORT_ROWS or smaller >= size or total < OWN_FILE_ROWS * files:
                break
            before = conf.get(_PART_BYTES)
            conf.set(_PART_BYTES, str(smaller))
            found = _parts(rows, PASSAGE_DAY)
            if _large(files, total, most) and not _large(*found):
                conf.set(_PART_BYTES, before)
                break
            size, (files, total, most) = smaller, found
        yield ready_to_add(passages, not _large(files, total, most))
    finally:
        conf.set(_PART_BYTES, given)


def append_passages(passages: DataFrame, path: str) -> None:
    """Append new passages.  Folders of new days appear by themselves."""
    with adding(passages) as rows:
        rows.write.mode("append").option(*PACKED).partitionBy(PASSAGE_DAY).parquet(path)
