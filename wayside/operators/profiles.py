"""Frequency profiles, the per-minute view and table spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions.calendar import minute_floor
from wayside.schemas import PASSAGE_DAY


def minute_counts(passages: DataFrame) -> DataFrame:
    """Passages per UTC minute and camera."""
    minute = minute_floor(F.col("passage_at")).alias("passage_at_minute")
    return passages.groupBy("camera_id", "camera_naam", minute).agg(
        F.count("passage_id").alias("count")
    )


# Fixed values.
CAMERA_COLUMNS = [
    "straat",
    "rijrichting",
    "rijstrook",
    "camera_id",
    "camera_naam",
    "camera_kijkrichting",
    "camera_locatie",
]


def camera_profile(passages: DataFrame) -> DataFrame:
    return passages.groupBy(*CAMERA_COLUMNS).agg(F.count(F.lit(1)).alias("count"))


# Profile columns in output order; the first set leaves as a hash.
HASHED_COLUMNS = [
    "kenteken_land",
    "voertuig_soort",
    "merk",
    "inrichting",
    "europese_voertuigcategorie",
    "europese_voertuigcategorie_toevoeging",
    "versit_klasse",
]
VEHICLE_COLUMNS = [
    "kenteken_land",
    "voertuig_soort",
    "merk",
    "inrichting",
    "datum_eerste_toelating",
    "datum_tenaamstelling",
    "toegestane_maximum_massa_voertuig",
    "europese_voertuigcategorie",
    "europese_voertuigcategorie_toevoeging",
    "taxi_indicator",
    "maximale_constructie_snelheid_bromsnorfiets",
    "brandstoffen",
    "extra_data",
    "diesel",
    "gasoline",
    "electric",
    "versit_klasse",
]


def vehicle_profile(passages: DataFrame) -> DataFrame:
    """Anonymous vehicle frequencies.

    Groups are formed on the values as stored and hashed afterwards, so each
    distinct value is hashed once per group; an unknown and a false taxi flag
    stay two groups that both read ``FALSE``.
    """
    grouped = [c for c in VEHICLE_COLUMNS if c != "datum_tenaamstelling"]
    counted = passages.groupBy(*grouped).agg(F.count(F.lit(1)).alias("count"))
    shown = {name: F.col(name) for name in VEHICLE_COLUMNS}
    shown.update({name: F.md5(F.col(name)) for name in HASHED_COLUMNS})
    shown["datum_tenaamstelling"] = F.lit(None).cast("date")
    shown["taxi_indicator"] = F.when(F.col("taxi_indicator"), F.lit("TRUE")).otherwise(
        F.lit("FALSE")
    )
    return counted.select(*[column.alias(name) for name, column in shown.items()], "count")


def day_span(passages: DataFrame) -> DataFrame:
    """First and last UTC day with data."""
    return passages.agg(
        F.to_date(F.min("passage_at")).alias("first_day"),
        F.to_date(F.max("passage_at")).alias("last_day"),
    )


def rows_per_day(passages: DataFrame) -> DataFrame:
    """Row count per day; on the stored table this reads no data column."""
    day = (
        F.col(PASSAGE_DAY)
        if PASSAGE_DAY in passages.columns
        else F.to_date("passage_at").alias(PASSAGE_DAY)
    )
    return passages.groupBy(day).agg(F.count(F.lit(1)).alias("count"))
