"""Helper tables from CSV, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.schemas import CAMERA, TAXI_AREA
from wayside.sources.files import path_exists
from wayside.sources.generations import current_folder, fresh_folder, retire, switch
from wayside.sources.lease import only_writer

# Header of the camera file.
CAMERA_CSV = [
    "camera_id",
    "vma_linknr",
    "camera_naam",
    "rijrichting",
    "rijrichting_correct",
    "camera_kijkrichting",
    "order_kaart",
    "order_naam",
    "cordon",
    "richting",
    "latitude",
    "longitude",
    "geom",
    "azimuth",
]
YES = "ja"


def _read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header in any column order, every value as text and ``''`` as
    NULL.  Quoted values may hold commas, quotes and line breaks."""
    found = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    )
    missing = set(columns) - set(found.columns)
    if missing:
        raise ValueError(f"columns missing from {path}: {sorted(missing)}")
    return found.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def load_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera table: ``ja`` is true and any other text false; the point holds
    latitude first and needs both coordinates."""
    rows = _read_text_csv(spark, path, CAMERA_CSV)
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    made = {
        "rijrichting_correct": F.lower("rijrichting_correct") == YES,
        "location": F.when(
            both,
            F.struct(
                F.col("latitude").cast("double").alias("x"),
                F.col("longitude").cast("double").alias("y"),
            ),
        ),
    }
    return rows.select(
        *[
            (made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in CAMERA.fields
        ]
    )


def load_taxi_areas(spark: SparkSession, path: str) -> DataFrame:
    return _read_text_csv(spark, path, TAXI_AREA.fieldNames())


SCHEMAS = {"cameras": CAMERA, "taxi_areas": TAXI_AREA}

# Columns that must be there, longest text, and the column without repeats.
REQUIRED = {"taxi_areas": ["id", "gebiedstype", "gebied", "camera_id"]}
LONGEST = {"taxi_areas": 255}
UNIQUE = {"taxi_areas": "id"}


class BrokenTable(ValueError):
    """A helper table breaks its rules; the table before it stays."""


def broken_rules(table: DataFrame, name: str) -> dict[str, int]:
    """How many rows break each rule of the helper table ``name``, without the kept ones."""
    counts = {f"{c}:required": F.count_if(F.col(c).isNull()) for c in REQUIRED.get(name, [])}
    if name in LONGEST:
        text = [f.name for f in table.schema if f.dataType == T.StringType()]
        counts |= {f"{c}:length": F.count_if(F.length(c) > LONGEST[name]) for c in text}
    if name in UNIQUE:
        key = UNIQUE[name]
        counts[f"{key}:unique"] = F.count(key) - F.count_distinct(key)
    if not counts:
        return {}
    found = table.agg(*[count.alias(rule) for rule, count in counts.items()]).first()
    return {rule: found[rule] for rule in counts if found[rule]}


def replace_table(table: DataFrame, name: str, root: str, wait: float = 0) -> int:
    """Full replace, all or nothing: write to a new folder, check it, then switch.

    Every later ``read_helper`` of any session finds the new rows.  Gives the number of
    rows now in the table.
    """
    spark = table.sparkSession
    place = f"{root.rstrip('/')}/{name}"
    with only_writer(spark, place, wait=wait) as lease:
        folder = fresh_folder(place)
        table.write.parquet(folder)
        written = spark.read.schema(table.schema).parquet(folder)
        broken = broken_rules(written, name)
        if broken:
            raise BrokenTable(f"{name} was not replaced: {broken}")
        switch(lease, folder)
        retire(lease)
        return written.count()


def read_helper(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The helper table that was loaded last."""
    folder = current_folder(spark, f"{root.rstrip('/')}/{name}")
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"{name} was never loaded into {root}")
    return spark.read.schema(SCHEMAS[name]).parquet(folder)
