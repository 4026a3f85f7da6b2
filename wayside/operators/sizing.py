"""Join strategies that look at the size of the side before choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions.keys import salt

# What every executor and the driver can hold.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 << 20

# Bytes of a row and of each of its values, besides what the values say as text.
ROW_BYTES, VALUE_BYTES = 32, 8

# Ways a hot key is split when the lookup is too large to broadcast.
SALTS = 32


def _row_bytes(lookup: DataFrame) -> Column:
    texts = [F.octet_length(F.col(f"`{c}`").cast("string")) for c in lookup.columns]
    return sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0).cast("long"))


def fits_broadcast(
    lookup: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Counts the rows and the bytes that are there; neither may pass its bound."""
    found = lookup.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(lookup)), F.lit(0)).alias("bytes")
    ).first()
    held = found["bytes"] + found["rows"] * (ROW_BYTES + VALUE_BYTES * len(lookup.columns))
    return found["rows"] <= (BROADCAST_MAX_ROWS if max_rows is None else max_rows) and held <= max_bytes


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Join a large side to a lookup on plain equality.

    A small lookup is broadcast.  A larger one is shuffled with every key split
    over ``SALTS`` buckets (``salt_by`` picks the bucket), so a key that holds a
    large part of all rows is still spread.  Both give the same rows.

    The larger one is marked for a merge: Spark estimates it from the size of its files,
    which knows nothing of the buckets, and would broadcast it all the same.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on, how)
    buckets = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # Its files may be one task's; the copies for the buckets are made by many.
    copies = lookup.repartition(SALTS).withColumn("_salt", buckets)
    return (
        facts.withColumn("_salt", salt(SALTS, *salt_by))
        .join(copies.hint("merge"), [*on, "_salt"], how)
        .drop("_salt")
    )
