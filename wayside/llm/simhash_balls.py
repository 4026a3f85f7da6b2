"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits; a bit is 1 where more than half of the hashes of
its word shingles have it.  Two fingerprints that differ in at most ``radius`` bits have
a value in the middle, half the radius away from either.  So every distinct fingerprint
gives out all variants within half the radius, variants are shuffled, and fingerprints
that meet in one are near.  A variant is met by at most as many distinct fingerprints as
a ball holds, however many documents share one, and a link from each to the smallest
there connects all of them: no pairs within a variant are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import (
    ASCII_LOWER_BYTES,
    SPACE_WORD,
    map_batches,
    stored,
    text_blocks,
    text_bytes,
)
from wayside.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2

# Balls grow with the radius: 65 variants at 2, 2,081 at 4.
MAX_RADIUS = 4

# ------------------------------------------------------------------ fingerprints


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, joined by one space."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - shingle + 1
    runs = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Eight counters of a byte are added at once, for as many rows as a byte can count.
    lanes = np.add.reduceat(bits.view("<u8"), np.arange(0, len(hashes), 255), axis=0)
    return lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    counts, total = np.zeros(BITS, np.int64), 0
    words: list[bytes] = []
    for block in text_blocks(text.translate(ASCII_LOWER_BYTES), SPACE_WORD):
        words += block.split()  # bytes split at the very characters SPACE_WORD leaves out
        if len(words) >= shingle:
            hashes = shingle_hashes(words, shingle)
            counts += bit_counts(hashes)
            total += len(hashes)
            words = words[len(hashes) :]
    if not total and words:
        counts, total = bit_counts(shingle_hashes(words, len(words))), 1
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > total).tolist())


def _fingerprint_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py(), shingle) for text in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "print"],
            )

    return run


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print), the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    return map_batches(rows, _fingerprint_task(shingle), "doc_id long, print long")


# ------------------------------------------------------------------------- balls


def ball(radius: int) -> list[int]:
    """The bits to flip for every value within ``radius``, as signed 64-bit numbers."""
    flips = [
        sum(1 << bit for bit in bits)
        for n in range(radius + 1)
        for bits in combinations(range(BITS), n)
    ]
    return np.array(flips, np.uint64).view(np.int64).tolist()


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, other): links between distinct fingerprints ``print`` that differ in at most
    ``radius`` bits, enough of them to connect all such pairs.

    Of an odd radius, one side goes out by the smaller half and the other by the larger;
    two that both went the longer way may be too far apart, so links go to the smallest
    fingerprint that went the shorter one.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"a radius is 0 to {MAX_RADIUS}, not {radius}")
    short = len(ball(radius // 2))
    flips = F.posexplode(F.lit(ball(radius - radius // 2))).alias("at", "flip")
    variants = prints.select("print", flips).select(
        F.col("print").bitwiseXOR(F.col("flip")).alias("variant"),
        "print",
        F.when(F.col("at") < short, F.col("print")).alias("middle"),
    )
    hub = F.min("middle").over(Window.partitionBy("variant"))
    return (
        variants.select("print", hub.alias("hub"))
        .filter("print != hub")
        .select(F.col("print").alias("node"), F.col("hub").alias("other"))
        .distinct()
        .filter(F.bit_count(F.col("node").bitwiseXOR(F.col("other"))) <= radius)
    )


def link_fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id that links reach.  Fewer words than a shingle
    are one shingle.  Without words, or null, a text has the fingerprint zero and is
    linked like any other.  Rows that share an id are linked by their fingerprints only;
    a null id is passed over, and the component is null where no row has an id.  An
    empty table gives no rows; other columns are ignored.
    """
    rows = stored(fingerprints(docs, text, shingle), "fingerprints")
    classes = stored(
        rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")),
        "fingerprint-classes",
    )
    roots = components(stored(near_links(classes.select("print"), radius), "near-links"))
    known = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    least = known.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("copies").alias("rows")
    )
    # Only fingerprints of several rows, or with links, need a row here.
    several = known.select("print", "root").join(least.filter("rows > 1"), "root")
    return rows.join(several.select("print", "component_id", "rows"), "print", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("rows") > 1, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
