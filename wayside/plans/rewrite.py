"""Rewrites of stored passages: bulk privacy, packing of small files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wayside.functions.privacy import mask
from wayside.schemas import PASSAGE_DAY
from wayside.sources.batches import batch_number
from wayside.sources.files import PACKED
from wayside.sources.generations import current_folder, fresh_folder, retire, switch
from wayside.sources.lease import only_writer
from wayside.sources.passages import laid_out, read_passages


def rewrite_history(
    spark: SparkSession,
    source: str,
    target: str,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """Masked copy of the days first … last, or of all days, under ``target``.

    Masking needs no shuffle: every task rewrites the files it read.  A long
    history can be done in ranges of days; doing a range again replaces it.
    Nothing switches to the copy: ``begin_masking`` does that.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write the masked copy to another folder")
    (
        mask(read_passages(spark, source, first, last))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PASSAGE_DAY)
        .parquet(target)
    )
    return read_passages(spark, target)


@dataclass(frozen=True)
class Rewriting:
    """A changed generation of ``table`` that has all batches up to ``through``, and was
    made from the generation in ``source``."""

    spark: SparkSession
    table: str
    change: Callable[[DataFrame], DataFrame]
    source: str
    target: str
    through: int

    def finish(self, wait: float = 0) -> None:
        """Change the batches that came since, then switch the table over."""
        with only_writer(self.spark, self.table, wait=wait) as lease:
            if current_folder(self.spark, self.table) != self.source:
                raise RuntimeError(f"{self.table} was replaced while it was rewritten")
            later = read_passages(self.spark, self.table).filter(batch_number() > self.through)
            changed = self.change(later)
            changed.write.mode("append").option(*PACKED).partitionBy(PASSAGE_DAY).parquet(self.target)
            switch(lease, self.target)
            retire(lease)


def begin_rewrite(
    spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame], wait: float = 0
) -> Rewriting:
    """Write all stored days, changed, into a new generation.

    The lease is held only while the files are listed, so batches go on being added to
    the table meanwhile; files of batches that began later are told by their number.
    Until ``finish``, readers keep to the old rows.
    """
    with only_writer(spark, table, wait=wait) as lease:
        source, through = current_folder(spark, table), lease.number
        stored = read_passages(spark, table)
    target = fresh_folder(table)
    changed = change(stored.filter(batch_number() <= through))
    changed.write.option(*PACKED).partitionBy(PASSAGE_DAY).parquet(target)
    return Rewriting(spark, table, change, source, target, through)


def begin_masking(spark: SparkSession, table: str, wait: float = 0) -> Rewriting:
    return begin_rewrite(spark, table, mask, wait)


def mask_table(spark: SparkSession, table: str, wait: float = 0) -> DataFrame:
    """All passages masked in place; every reader that comes later sees masked rows."""
    begin_masking(spark, table, wait).finish(wait)
    return read_passages(spark, table)


def packed(passages: DataFrame) -> DataFrame:
    """The same rows in few sorted files per day."""
    return laid_out(passages, PASSAGE_DAY, "camera_naam", "passage_at")


def compact_table(spark: SparkSession, table: str, wait: float = 0) -> DataFrame:
    """Pack the small files of many batches.

    All days are written anew, so this is for times when many days have small files.
    Readers find the rows once at any time: in the old files or in the new.
    """
    begin_rewrite(spark, table, packed, wait).finish(wait)
    return read_passages(spark, table)
