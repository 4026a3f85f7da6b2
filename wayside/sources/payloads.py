"""Payload files: one JSON document per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayside.operators.ingest import read_validated


def read_payloads(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Validated records of a folder of payload files (``v1`` flat, ``v2``
    nested)."""
    return read_validated(spark.read.text(path), version)


def stream_payloads(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The payload lines as a stream.  A message topic with a text ``value``
    column serves as well."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
