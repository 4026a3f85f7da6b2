"""Day windows, declared attribute filters and the newest-first page."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions.calendar import local_day_bounds, utc_day_bounds
from wayside.schemas import NATURAL_KEY, PASSAGE_DAY


def _between(passages: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``start <= passage_at < end``, with the same range on the partition
    column where there is one: the bounds are converted, never the column, so
    both predicates reach the scan."""
    at = F.col("passage_at")
    kept = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    if PASSAGE_DAY in passages.columns:
        last = (end - timedelta(microseconds=1)).date()
        kept = kept & F.col(PASSAGE_DAY).between(F.lit(start.date()), F.lit(last))
    return passages.filter(kept)


def in_utc_days(passages: DataFrame, first: date, last: date | None = None) -> DataFrame:
    return _between(passages, *utc_day_bounds(first, last or first))


def in_local_days(passages: DataFrame, first: date, last: date | None = None) -> DataFrame:
    return _between(passages, *local_day_bounds(first, last or first))


_EXACT = ["exact"]
_ORDER = ["exact", "lt", "gt"]
_FLAG = ["isnull", "exact", "lt", "gt"]

# The comparisons each column may be filtered by.
FILTERS = {
    "merk": _EXACT,
    "voertuig_soort": _EXACT,
    "indicatie_snelheid": _EXACT,
    "kenteken_nummer_betrouwbaarheid": _EXACT,
    "version": _EXACT,
    "kenteken_land": _EXACT,
    "toegestane_maximum_massa_voertuig": _EXACT,
    "europese_voertuigcategorie": _EXACT,
    "europese_voertuigcategorie_toevoeging": _EXACT,
    "taxi_indicator": _EXACT,
    "maximale_constructie_snelheid_bromsnorfiets": _EXACT,
    "created_at": _ORDER,
    "passage_at": _ORDER,
    "diesel": _FLAG,
    "gasoline": _FLAG,
    "electric": _FLAG,
}


def _comparison(column: Column, how: str, value) -> Column:
    if how == "isnull":
        return column.isNull() if value else column.isNotNull()
    literal = F.lit(value)
    if isinstance(value, datetime):
        literal = literal.cast("timestamp_ntz")
    return {"exact": column == literal, "lt": column < literal, "gt": column > literal}[how]


def by_attributes(passages: DataFrame, **criteria) -> DataFrame:
    """Keep rows that meet all criteria, written ``column`` or ``column__how``."""
    for name, value in criteria.items():
        column, _, how = name.partition("__")
        how = how or "exact"
        if how not in FILTERS.get(column, ()):
            raise ValueError(f"no filter {how!r} on {column!r}")
        passages = passages.filter(_comparison(F.col(column), how, value))
    return passages


# Fixed values.
PAGE_SIZE = 50
MAX_PAGE_SIZE = 10_000


def newest(passages: DataFrame, size: int = PAGE_SIZE, after: dict | None = None) -> DataFrame:
    """One page of passages, newest first.

    ``after`` holds ``passage_at``, ``passage_id`` and ``volgnummer`` of the last
    row of the page before.  A page of more than ``MAX_PAGE_SIZE`` rows is an error,
    not a shorter page.  Spark keeps the top rows per task, so no task sorts
    the whole table.
    """
    if not 0 < size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page has 1 to {MAX_PAGE_SIZE} rows, not {size}")
    if after:
        at, ident, number = (F.col(c) for c in ("passage_at", "passage_id", "volgnummer"))
        last_at = F.lit(after["passage_at"]).cast("timestamp_ntz")
        passages = passages.filter(
            (at < last_at)
            | ((at == last_at) & (ident > after["passage_id"]))
            | (
                (at == last_at)
                & (ident == after["passage_id"])
                & (number > after["volgnummer"])
            )
        )
    order = [F.col("passage_at").desc()] + [F.col(c) for c in NATURAL_KEY if c != "passage_at"]
    return passages.orderBy(*order).limit(size)
