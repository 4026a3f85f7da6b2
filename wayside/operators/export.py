"""Hourly export and per-camera deliveries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.functions.calendar import last_week
from wayside.functions.keys import record_id
from wayside.operators.sizing import lookup_join
from wayside.schemas import NATURAL_KEY, PASSAGE_DAY, REST


def hourly_totals(
    hours: DataFrame,
    today: date | None = None,
    year: int | None = None,
    week: int | None = None,
) -> DataFrame:
    """Totals per camera and hour from the passage-hour table.

    ``year`` and ``week`` filter exactly; with neither, the result is the ISO
    week before ``today``.
    """
    if year is None and week is None:
        if today is None:
            raise ValueError("give today, or a year or week")
        monday, sunday = last_week(today)
        hours = hours.filter(F.col("date").between(F.lit(monday), F.lit(sunday)))
    if year is not None:
        hours = hours.filter(F.col("year") == year)
    if week is not None:
        hours = hours.filter(F.col("week") == week)
    bucket = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return hours.groupBy("camera_id", "camera_naam", bucket.alias("bucket")).agg(
        F.sum("count").alias("sum")
    )


# Delivered columns, in order.
DELIVERY_COLUMNS = [
    "id",
    "passage_at",
    "created_at",
    "version",
    "straat",
    "rijrichting",
    "rijstrook",
    "camera_id",
    "camera_naam",
    "camera_kijkrichting",
    "camera_locatie",
    "kenteken_land",
    "kenteken_nummer_betrouwbaarheid",
    "kenteken_land_betrouwbaarheid",
    "kenteken_karakters_betrouwbaarheid",
    "automatisch_verwerkbaar",
    "voertuig_soort",
    "inrichting",
    "toegestane_maximum_massa_voertuig",
    "europese_voertuigcategorie",
    "europese_voertuigcategorie_toevoeging",
    "brandstoffen",
    "extra_data",
    "diesel",
    "gasoline",
    "electric",
    "indicatie_snelheid",
]


def camera_delivery(
    passages: DataFrame, cameras: list[str] | DataFrame, first: date, last: date
) -> DataFrame:
    """Delivery columns of the passages of some cameras on UTC days first … last.

    ``cameras`` is a short list of ids or a table with a ``camera_id`` column.
    ``id`` follows from the natural key.
    """
    day = F.to_date("passage_at")
    if PASSAGE_DAY in passages.columns:
        day = F.col(PASSAGE_DAY)
    chosen = passages.filter(day.between(F.lit(first), F.lit(last)))
    if isinstance(cameras, DataFrame):
        wanted = cameras.select("camera_id").distinct()
        chosen = lookup_join(chosen, wanted, ["camera_id"], "inner", NATURAL_KEY)
    else:
        chosen = chosen.filter(F.col("camera_id").isin(cameras))
    return chosen.withColumn("id", record_id()).select(
        *[c for c in DELIVERY_COLUMNS], day.alias(PASSAGE_DAY)
    )


def _delivered(field: T.StructField) -> Column:
    """Text of one value: flags as t/f, points as EWKT, lists as JSON."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(column, F.lit("t")).when(~column, F.lit("f"))
    if isinstance(field.dataType, T.StructType):
        return F.when(
            column.isNotNull(), F.format_string("SRID=4326;POINT(%s %s)", column["x"], column["y"])
        )
    if isinstance(field.dataType, T.ArrayType):
        return list_json(column)
    return column.cast("string")


def list_json(column: Column) -> Column:
    """A list as JSON, the rest of each item among its fields."""

    def item(source: Column) -> Column:
        known, rest = F.to_json(source.dropFields(REST)), source[REST]
        joint = F.when(known == "{}", "").otherwise(",")
        both = F.concat(F.left(known, F.length(known) - 1), joint, F.substr(rest, F.lit(2)))
        return F.when(rest.isNull(), known).otherwise(both)

    items = F.array_join(F.transform(column, item), ",")
    return F.when(column.isNotNull(), F.concat(F.lit("["), items, F.lit("]")))


def delivery_text(delivery: DataFrame) -> DataFrame:
    return delivery.select(
        *[
            F.col(f.name) if f.name == PASSAGE_DAY else _delivered(f).alias(f.name)
            for f in delivery.schema.fields
        ]
    )
