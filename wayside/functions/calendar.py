"""Calendar expressions on zone-less UTC timestamps.

All truncation is done with zone-free arithmetic: ``date_trunc`` would return a
zoned TIMESTAMP even for a zone-less input.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The session setting that holds the IANA name of the roadside's zone.
ZONE_SETTING = "spark.wayside.localZone"

# Weekday labels, Monday first.
WEEKDAY_LABELS = [
    "1 maandag",
    "2 dinsdag",
    "3 woensdag",
    "4 donderdag",
    "5 vrijdag",
    "6 zaterdag",
    "7 zondag",
]


def local_zone() -> str:
    """The zone of the active session; there is no default."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get(ZONE_SETTING, None) if session else None
    if not zone:
        raise ValueError(f"set {ZONE_SETTING} to the zone of the roadside")
    return zone


def local_time(ts: Column) -> Column:
    """Wall-clock time at the roadside for a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(local_zone()), ts)


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_floor(ts: Column) -> Column:
    return day_start(ts) + F.make_dt_interval(hours=F.hour(ts))


def minute_floor(ts: Column) -> Column:
    return day_start(ts) + F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts))


def day_of_week(ts: Column) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(ts) - 1


def weekday_label(ts: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in WEEKDAY_LABELS])
    return F.element_at(labels, F.weekday(ts) + 1)


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Date, year, month, day, ISO week, day of week and hour.

    ``year`` is the calendar year and ``week`` the ISO week, so the first days
    of January can carry week 52 or 53 of the year they are *in*.
    """
    return {
        "date": F.to_date(ts),
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "week": F.weekofyear(ts),
        "day_of_week": day_of_week(ts),
        "hour": F.hour(ts),
    }


def passage_parts(ts: Column) -> list[Column]:
    """Calendar parts under their ``passage_at_`` names; the weekday is text."""
    parts = calendar_parts(ts)
    parts["day_of_week"] = parts["day_of_week"].cast("string")
    return [column.alias(f"passage_at_{name}") for name, column in parts.items()]


def local_midnight_utc(day: date) -> datetime:
    """The UTC instant, without zone, at which a local day starts."""
    midnight = datetime.combine(day, time(), tzinfo=ZoneInfo(local_zone()))
    return midnight.astimezone(timezone.utc).replace(tzinfo=None)


def utc_day_bounds(first: date, last: date) -> tuple[datetime, datetime]:
    """Half-open UTC range of the UTC days first … last."""
    return (
        datetime.combine(first, time()),
        datetime.combine(last + timedelta(days=1), time()),
    )


def local_day_bounds(first: date, last: date) -> tuple[datetime, datetime]:
    """Half-open UTC range of the local days first … last (23 or 25 hours on a
    day the clock changes)."""
    return local_midnight_utc(first), local_midnight_utc(last + timedelta(days=1))


def last_week(today: date) -> tuple[date, date]:
    """Monday and Sunday of the ISO week before the one ``today`` is in."""
    monday = today - timedelta(days=today.weekday() + 7)
    return monday, monday + timedelta(days=6)


def days_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=n) for n in range((last - first).days + 1)]
