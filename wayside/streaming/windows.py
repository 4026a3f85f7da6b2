"""Passage streams into tables: each key once, and tumbling counts.

Rows may come in any order and at any age.  There is no watermark to fall behind: a
micro-batch meets the stored rows of its own days, and what it adds is counted by itself
and added to the counts.  A micro-batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wayside.plans.counts import update_counts
from wayside.plans.ingest import store_new
from wayside.sources.files import staged
from wayside.sources.lease import LASTS
from wayside.streaming.runs import run_id


def start_storing(
    passages: DataFrame,
    table: str,
    checkpoint: str,
    then: Callable[[], object] | None = None,
    trigger: dict | None = None,
    wait: float = LASTS,
) -> StreamingQuery:
    """Append every passage whose key is new to ``table``, whatever its age; ``then``
    is called after each micro-batch."""
    run = run_id(passages.sparkSession, checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        with staged(batch, "batch") as rows:
            store_new(rows, table, f"{run}-{number}", wait)
        if then:
            then()

    return (
        passages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_counts(
    passages: DataFrame,
    table: str,
    counts: str,
    checkpoint: str,
    length: str = "hour",
    trigger: dict | None = None,
    wait: float = LASTS,
) -> StreamingQuery:
    """Store the stream and keep the table of its counts."""

    def count() -> None:
        update_counts(passages.sparkSession, table, counts, length, wait)

    return start_storing(passages, table, checkpoint, count, trigger, wait)
