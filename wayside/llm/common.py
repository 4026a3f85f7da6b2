"""Small helpers the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.session import checkpointed, configure, scratch_path

# Arrow batches are bounded in bytes as well as in rows: one text may be long.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

# A-Z only: other letters keep their case, unlike str.lower().
ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
ASCII_LOWER_BYTES = bytes(ASCII_LOWER.get(b, b) for b in range(256))

# Words end at ASCII white space; the bytes 0x09-0x0D and 0x20 occur in UTF-8
# only as those characters.
SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE_WORD_SQL = r"[^\x20\x09-\x0D]+"

# Bytes of text whose words are held at once.
BLOCK_BYTES = 1 << 18


def text_blocks(text: bytes, word: re.Pattern, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text a block at a time; blocks end where no word goes on."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + size
        cut = word.match(text, end) if end < len(text) else None
        end = cut.end() if cut else end
        yield text[at:end]
        at = end


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library and bounded Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Run ``function`` over the Arrow batches of every partition."""
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The finished rows in the shared folder: lineage ends there, and several
    readers find the same rows whatever executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_row_key(df: DataFrame, label: str) -> DataFrame:
    """``df`` with a number of its own for every row in ``row_key``, the same whenever a
    task runs again.

    Files give their rows in one order; what comes from a shuffle may not, and is stored
    first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = stored(df, label)
    return df.select("*", F.monotonically_increasing_id().alias("row_key"))


__all__ = [
    "ASCII_LOWER",
    "ASCII_LOWER_BYTES",
    "BLOCK_BYTES",
    "SPACE_WORD",
    "SPACE_WORD_SQL",
    "checkpointed",
    "id_remainder",
    "lower_ascii",
    "map_batches",
    "prepared",
    "stored",
    "table",
    "text_blocks",
    "text_bytes",
    ]
