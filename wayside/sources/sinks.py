"""CSV outputs, written by all tasks in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayside.operators.export import delivery_text
from wayside.schemas import PASSAGE_DAY

# Fixed values.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DELIVERY_SEPARATOR = ";"


def write_hourly_csv(totals: DataFrame, path: str) -> int:
    """Export in bucket order; every part file starts with the header, and the
    files in name order hold the rows in order.  Without rows there is no header
    either.  Gives the number of rows."""
    written = Observation()
    (
        totals.withColumn("bucket", F.date_format("bucket", TIMESTAMP_FORMAT))
        .orderBy("bucket", "camera_id", "camera_naam")
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
    rows = written.get["rows"]
    if rows == 0:
        empty = totals.sparkSession.createDataFrame([], "camera_id string")
        empty.write.mode("overwrite").option("header", False).csv(path)
    return rows


def write_delivery_csv(delivery: DataFrame, path: str) -> None:
    """One folder of ``;``-separated files without header per day."""
    (
        delivery_text(delivery)
        .hint("rebalance", F.col(PASSAGE_DAY))
        .write.mode("overwrite")
        .partitionBy(PASSAGE_DAY)
        .option("sep", DELIVERY_SEPARATOR)
        .option("escape", '"')
        .option("emptyValue", '""')
        .csv(path)
    )
