"""Identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayside.schemas import NATURAL_KEY

_HYPHENS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def hyphenate(digits: Column) -> Column:
    """32 hexadecimal digits in UUID form."""
    return F.regexp_replace(digits, _HYPHENS, "$1-$2-$3-$4-$5")


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form, or NULL where the text is no UUID.  Two
    spellings of one id must meet in the natural key."""
    digits = F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(text)), r"^(urn:uuid:|urn:|uuid:)", ""), r"[-{}]", ""
    )
    return F.when(digits.rlike("^[0-9a-f]{32}$"), hyphenate(digits))


def record_id(*key: str) -> Column:
    """Repeatable UUID-shaped id of a passage, from its natural key."""
    key = key or tuple(NATURAL_KEY)
    return hyphenate(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])))


def salt(buckets: int, *columns: str) -> Column:
    """A bucket number that follows from the row's own values, so a task that
    is run again puts every row where it was."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
