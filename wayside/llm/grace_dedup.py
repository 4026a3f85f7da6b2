"""Exact deduplication by Grace hashing.

Spark's shuffle deals the records by digest, which is the first level of
partitioning.  Inside a task the records meet an open-addressing table that
compares complete contents; what does not fit goes to spill files by another hash
and each file is treated the same way, until its distinct contents fit.  Every map
task merges its own copies first, so a text that a third of all rows share reaches
the shuffle once per task.

Spill files are nameless and belong to one task, in one of the folders Spark gives it
for spills: they vanish with it and no other task reads them.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import map_batches, text_bytes

# Bytes a task's table may hold, contents and entries, before records are spilled.
TABLE_BYTES = 64 << 20

# What an entry takes besides its content: slots, a list, a digest and numbers.
ENTRY_BYTES = 400

# Spill files per level.
FANOUT = 16

CLASSES = "digest binary, content binary, keep_id long, members long"
_ARROW = pa.schema(
    [
        ("digest", pa.binary()),
        ("content", pa.binary()),
        ("keep_id", pa.int64()),
        ("members", pa.int64()),
    ]
)

Record = tuple[bytes, bytes, "int | None", int]


class ContentTable:
    """Open addressing with linear probing; equal means equal contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """The slot where the search ended and the entry there, or -1."""
        mask = len(self.slots) - 1
        slot = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[slot]) >= 0:
            if self.entries[entry][1] == content:
                return slot, entry
            if self.entries[entry][0] == digest:
                raise RuntimeError("two different contents have one SHA-256 digest")
            slot = (slot + 1) & mask
        return slot, -1

    def add(self, slot: int, record: Record) -> None:
        self.slots[slot] = len(self.entries)
        self.entries.append(list(record))
        self.bytes += ENTRY_BYTES + len(record[1])
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for number, entry in enumerate(self.entries):
            slot = int.from_bytes(entry[0][:8], "little") & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = number


def larger(a: int | None, b: int | None) -> int | None:
    """The larger id; null is the smallest."""
    return b if a is None else a if b is None else max(a, b)


def merged(records: Iterable[Record], table_bytes: int, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content, with the largest id and all members."""
    table, spills = ContentTable(), {}
    for record in records:
        slot, entry = table.find(record[0], record[1])
        if entry >= 0:
            held = table.entries[entry]
            held[2] = larger(held[2], record[2])
            held[3] += record[3]
        elif not table.entries or table.bytes + ENTRY_BYTES + len(record[1]) <= table_bytes:
            table.add(slot, record)
        else:
            bucket = xxhash.xxh64_intdigest(record[0], seed=level) % FANOUT
            if bucket not in spills:
                spills[bucket] = tempfile.TemporaryFile(dir=spill_folder(bucket))
            pickle.dump(record, spills[bucket], protocol=pickle.HIGHEST_PROTOCOL)
    yield from map(tuple, table.entries)
    del table
    for spill in spills.values():
        spill.seek(0)
        yield from merged(_read(spill), table_bytes, level + 1)
        spill.close()


def spill_folder(bucket: int) -> str | None:
    """One of the task's local folders, as Spark names them; outside a task Python's own."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return folders[bucket % len(folders)] or None


def _read(spill) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(spill)
        except EOFError:
            return


def _merge_task(table_bytes: int, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        rows, size = [], 0
        for digest, content, keep_id, members in merged(records, table_bytes):
            rows.append((digest, content if with_content else b"", keep_id, members))
            size += len(content)
            if size > 8 << 20 or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[Record]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, _ARROW)], schema=_ARROW
    )


def _digest(column: str):
    return F.unhex(F.sha2(text_bytes(column), 256))


def content_classes(docs: DataFrame, text: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(digest, keep_id, members) for each distinct text."""
    records = docs.select(
        _digest(text).alias("digest"),
        text_bytes(text).alias("content"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("members"),
    )
    local = map_batches(records, _merge_task(table_bytes, True), CLASSES)
    dealt = local.repartition("digest")
    return map_batches(dealt, _merge_task(table_bytes, False), CLASSES).drop("content")


def find_copies(docs: DataFrame, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Each document with the copy that stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.
    Null texts are empty texts.  Of equal texts the largest ``doc_id`` stays; a null
    id is smaller than any other and stays only if the group has no other.  Rows
    that repeat an id and a text are members of the group, and one of them stays.
    An empty table gives no rows; other columns are ignored.
    """
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"))
        .groupBy("doc_id", "digest")
        .agg(F.count("*").alias("repeats"))
    )
    groups = content_classes(docs, text, table_bytes).filter("members > 1")
    grouped = F.col("members").isNotNull()
    return (
        rows.join(groups, "digest", "left")
        .withColumn("keep_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")))
        .withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("members", F.lit(1).cast("long")).alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("number") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; ties as in ``find_copies``."""
    stay = (
        find_copies(docs, text, table_bytes)
        .filter("kept")
        .select(
            F.coalesce("doc_id", F.lit(-1)).alias("_stay_id"),
            F.col("doc_id").isNull().alias("_stay_null"),
            F.unhex("text_sha256").alias("_stay_digest"),
        )
    )
    keys = ["_stay_id", "_stay_null", "_stay_digest"]
    keyed = docs.withColumns(
        {
            "_stay_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
            "_stay_null": F.col("doc_id").isNull(),
            "_stay_digest": _digest(text),
        }
    )
    first = Window.partitionBy(*keys).orderBy(*keys)
    return (
        keyed.join(stay, keys)
        .withColumn("_stay_number", F.row_number().over(first))
        .filter("_stay_number = 1")
        .drop(*keys, "_stay_number")
    )
