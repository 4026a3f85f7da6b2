"""Tumbling counts kept beside a passage table, from the batches that are new.

Passages are only ever added, so the counts of a window are a sum over batches.  A
counts table is a list of parts: one for the batches counted at a time, and merged ones.
A small file names the parts that count and the batch they reach; it is replaced as the
last step.  Bringing the counts up to date reads the files of later batches and nothing
else of their days, whatever the age of the rows.  Parts of like size are merged, so
there are few and a row is merged some ten times at most.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.calendar import hour_floor, minute_floor
from wayside.sources.batches import read_log, rows_of
from wayside.sources.files import read_content, remove, write_over
from wayside.sources.generations import GRACE, generation
from wayside.sources.lease import Lease, log_folder, only_writer

# Window lengths and how a time is cut to the window's start.
LENGTHS = {"hour": hour_floor, "minute": minute_floor}
KEYS = ["window_start", "camera_id", "camera_naam"]
COUNTS = "window_start timestamp_ntz, camera_id string, camera_naam string, count long"

# A part is merged with the one before it unless that has more than this times its rows.
MERGE = 2


def window_counts(passages: DataFrame, length: str = "hour") -> DataFrame:
    """Passages per camera and tumbling window."""
    start = LENGTHS[length](F.col("passage_at")).alias("window_start")
    return passages.groupBy(start, "camera_id", "camera_naam").agg(
        F.count(F.lit(1)).alias("count")
    )


def _added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def _state_path(counts: str) -> str:
    return f"{log_folder(counts)}/parts.json"


def _state(spark: SparkSession, counts: str) -> dict:
    none = {"through": 0, "length": None, "parts": [], "retired": []}
    return read_content(spark, _state_path(counts)) or none


def _read(spark: SparkSession, counts: str, parts: list[dict]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(*[f"{counts}/{part['folder']}" for part in parts])


def _write(rows: DataFrame, counts: str) -> dict:
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{counts}/{folder}")
    written = rows.sparkSession.read.schema(COUNTS).parquet(f"{counts}/{folder}")
    return {"folder": folder, "rows": written.count()}


def _merged(lease: Lease, parts: list[dict]) -> tuple[list[dict], list[dict]]:
    """Parts with a falling number of rows, and those that no longer count."""
    spark, counts, gone = lease.spark, lease.table, []
    size = 1
    while len(parts) > size and parts[-size - 1]["rows"] <= MERGE * sum(p["rows"] for p in parts[-size:]):
        size += 1
    if size > 1:
        gone = parts[-size:]
        whole = _write(_added_up(_read(spark, counts, gone)), counts)
        parts = [*parts[:-size], whole]
    return parts, gone


def update_counts(
    spark: SparkSession, table: str, counts: str, length: str = "hour", wait: float = 0
) -> bool:
    """Count the batches of ``table`` that ``counts`` does not have; false if there are none.

    A table that was rewritten since its batches were counted last has lost the numbers
    of its files and is counted afresh.
    """
    with only_writer(spark, counts, wait=wait) as lease:
        log, state = read_log(spark, table), _state(spark, counts)
        if state["length"] not in (None, length):
            raise ValueError(f"{counts} holds counts by {state['length']}, not by {length}")
        through = state["through"]
        if log is None or log.through <= through:
            return False
        afresh = generation(spark, table) > through or not state["parts"]
        later = [days for number, days in log.loose if number > through]
        if afresh:
            rows = rows_of(spark, table, -1, log.through)
        elif log.folded > through:  # the days of some batches are not known apart
            rows = rows_of(spark, table, through, log.through)
        else:
            rows = rows_of(spark, table, through, log.through, sum(later, ()))
        parts = [] if afresh else state["parts"]
        gone = state["parts"] if afresh else []
        parts, merged = _merged(lease, [*parts, _write(window_counts(rows, length), counts)])
        now = time.time()
        retired = [{**part, "at": now} for part in [*gone, *merged]] + state["retired"]
        over = [part for part in retired if part["at"] + GRACE <= now]
        lease.check()
        write_over(
            spark,
            _state_path(counts),
            {
                "through": log.through,
                "length": length,
                "parts": parts,
                "retired": [part for part in retired if part not in over],
            },
        )
        for part in over:
            remove(spark, f"{counts}/{part['folder']}")
        return True


def read_counts(spark: SparkSession, counts: str) -> DataFrame:
    return _added_up(_read(spark, counts, _state(spark, counts)["parts"]))
