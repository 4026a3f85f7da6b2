"""Importance resampling towards a target by hashed word n-grams.

A text's features are its runs of one to three words, hashed to buckets by CRC-32.  A
bucket's gain says how much likelier it is in the target than in the documents; a text's
weight is the sum of its features' gains.  Adding Gumbel noise that follows from the id
and taking the highest scores draws without replacement in proportion to the weights.

Texts are taken a batch at a time: they are joined with a sentinel after each, one regex
pass finds all words, and a binary search of each word's place in the places of the
sentinels gives its document, so that runs across two documents are masked before
buckets are counted.  The CRC of a run follows from those of its words, because
appending is linear, so n-grams are hashed without building their text.  A long text
goes by itself in blocks that carry their last words on.

Counts of buckets are added up by task and by Spark; the driver holds one number per
bucket.  Ranks come from a range partitioning by score with the sizes of its parts.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import ASCII_LOWER_BYTES, map_batches, stored, text_blocks, text_bytes

# Words are ASCII digits and letters, lower-cased, and all characters beyond ASCII: in
# UTF-8 these are bytes from 0x80 to 0xF4, so 0xFF can stand between texts.
SENTINEL = b"\xff"
WORD = re.compile(rb"[0-9a-z\x80-\xf4]+")
TOKEN = re.compile(WORD.pattern + rb"|\xff")

BUCKETS = 10_000
NGRAM = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

# Bytes of text joined for one pass.
JOINED_BYTES = 1 << 20

# ------------------------------------------------------------------------ hashing

# CRC-32 of a text with n bytes appended is a linear map of its CRC, xor the CRC of
# these bytes.  The maps are kept as tables by byte: one for every length up to DIRECT,
# and for the doublings of DIRECT.
POLYNOMIAL = 0xEDB88320
DIRECT = 128
DOUBLINGS = 25


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


def _mapped(tables: np.ndarray, crc: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """Each CRC through its table ``at``; tables stand one after the other, by byte."""
    base = np.asarray(at, np.int64) << 10
    out = tables.take(base + (crc & np.uint32(255)))
    for n in (1, 2, 3):
        byte = (crc >> np.uint32(8 * n)) & np.uint32(255)
        out ^= tables.take(base + (n << 8) + byte)
    return out


def _length_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    byte = _byte_table()
    direct = np.empty((DIRECT + 1, 1024), np.uint32)
    places = np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    direct[0] = (np.arange(256, dtype=np.uint32) << places).ravel()
    for n in range(DIRECT):
        direct[n + 1] = (direct[n] >> np.uint32(8)) ^ byte[direct[n] & np.uint32(255)]
    doubled = [direct[DIRECT]]
    for _ in range(DOUBLINGS):
        doubled.append(_mapped(doubled[-1], doubled[-1]))
    return direct.ravel(), doubled


_DIRECT, _DOUBLED = _length_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of each CRC that stays when so many bytes are appended."""
    out = _mapped(_DIRECT, crc, lengths % DIRECT)
    rest, level = lengths // DIRECT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _mapped(_DOUBLED[level], out[odd])
        rest, level = rest >> 1, level + 1
    return out


def token_codes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: is it the sentinel, its CRC, that with a space before, its length.

    All are looked up once per distinct token.
    """
    at = pa.array(tokens, pa.binary()).dictionary_encode().indices.to_numpy()
    # Numbers are given in the order of first occurrence.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
    distinct = [tokens[n] for n in first.tolist()]
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    spaced = shifted(np.full(len(distinct), zlib.crc32(b" "), np.uint32), lengths) ^ crc
    ends = np.fromiter((token == SENTINEL for token in distinct), bool, len(distinct))
    return ends[at], crc[at], spaced[at], lengths[at]


def hashed_runs(
    tokens: list[bytes], ngram: int, carried: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``ngram``: the CRCs of all runs of so many words within a
    document, and the number of that document among those of ``tokens``.

    Runs that end in the first ``carried`` tokens are left out.
    """
    is_end, run, spaced, lengths = token_codes(tokens)
    document = np.searchsorted(np.flatnonzero(is_end), np.arange(len(tokens)))
    for size in range(1, ngram + 1):
        back = size - 1
        inside = ~is_end[back:] & (document[back:] == document[: len(tokens) - back])
        if back:
            # Runs of one word less, with the word that follows.
            run = shifted(run[:-1], lengths[back:] + 1) ^ spaced[back:]
        new = np.flatnonzero(inside)
        new = new[new + back >= carried] if carried else new
        yield run[new], document[new]


def feature_blocks(
    texts: list[bytes], ngram: int, buckets: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, bucket, text) of all features, by the number of words in a feature."""

    def hashed(tokens: list[bytes], numbers: list[int], carried: int = 0):
        owner = np.array(numbers, np.int64)
        for size, (run, document) in enumerate(hashed_runs(tokens, ngram, carried), 1):
            yield size, (run % np.uint32(buckets)).astype(np.int64), owner[document]

    joined: list[bytes] = []
    numbers: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        if len(text) >= JOINED_BYTES:
            carried: list[bytes] = []
            for block in text_blocks(text.translate(ASCII_LOWER_BYTES), WORD):
                tokens = carried + WORD.findall(block)
                yield from hashed([*tokens, SENTINEL], [number], len(carried))
                carried = tokens[max(0, len(tokens) - ngram + 1) :] if ngram > 1 else []
            continue
        joined += [text, SENTINEL]
        numbers.append(number)
        held += len(text)
        if held >= JOINED_BYTES:
            yield from hashed(_tokens(joined), numbers)
            joined, numbers, held = [], [], 0
    if numbers:
        yield from hashed(_tokens(joined), numbers)


def _tokens(joined: list[bytes]) -> list[bytes]:
    return TOKEN.findall(b"".join(joined).translate(ASCII_LOWER_BYTES))


# ------------------------------------------------------------------------- gains


def _count_task(ngram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column("content").to_pylist()
            for _, bucket, _ in feature_blocks(texts, ngram, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; one number per bucket comes to the driver."""
    rows = docs.select(text_bytes(text).alias("content"))
    summed = (
        map_batches(rows, _count_task(ngram, buckets), "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():
        counts[row.bucket] = row.n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the source's), one added to each count."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


# ------------------------------------------------------------------------ scores


def gumbel(seed: int, doc_id: int | None) -> int:
    """Noise that follows from the id; a null id counts as empty text."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = "doc_id long, n_features long, n_words long, weight long, score long, tie long"


def _score_task(gains: np.ndarray, ngram: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = batch.num_rows
            words, features, weights = np.zeros((3, n), np.int64)
            texts = batch.column("content").to_pylist()
            for size, bucket, number in feature_blocks(texts, ngram, len(gains)):
                found = np.bincount(number, minlength=n)
                features += found
                words += found if size == 1 else 0
                # Sums of a block are far below 2**53, so floats hold them exactly.
                summed = np.bincount(number, weights=gains[bucket], minlength=n)
                weights += summed.astype(np.int64)
            noise = [gumbel(seed, doc_id) for doc_id in batch.column("doc_id").to_pylist()]
            scores = weights + np.array(noise, np.int64)
            columns = [features, words, weights, scores, np.arange(done, done + n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)],
                ["doc_id", "n_features", "n_words", "weight", "score", "tie"],
            )
            done += n

    return run


def _number_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part's number and the row's place in it."""
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(done, done + n))],
            [*batch.schema.names, "part", "place"],
        )
        done += n


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their rank in the whole order, from 1.

    Rows are range-partitioned by the order and numbered in each part; what stands
    before a part follows from the sizes of the parts.
    """
    schema = f"{rows._jdf.schema().toDDL()}, part long, place long"
    numbered = stored(
        map_batches(
            rows.repartitionByRange(*order).sortWithinPartitions(*order), _number_task, schema
        ),
        "ranked",
    )
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for row in sizes:
        before.append((row.part, total))
        total += row.n
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place") + 1
    return numbered.join(F.broadcast(offsets), "part").select(*rows.columns, rank.alias("rank"))


def rank_by_importance(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``.

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) are
    drawn: those with the highest scores, ties going to the smaller id.  ``rank`` is
    their place, from 1, and null for all others.

    A text that is null or has no words has no features and the weight 0.  A null id is
    smaller than any other and has the noise of an empty one.  Rows that share id and
    score are ranked one after the other in any order.  Without target texts all gains
    compare with an even spread over the buckets.  An empty table gives no rows; other
    columns are ignored.
    """
    gains = bucket_gains(
        bucket_counts(docs, text, ngram, buckets), bucket_counts(target, target_text, ngram, buckets)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    scores = stored(map_batches(rows, _score_task(gains, ngram, seed), SCORES), "scores")
    able = scores.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    places = ranked(able, [F.col("score").desc(), F.col("doc_id").asc(), F.col("tie").asc()])
    columns = ["doc_id", "n_features", "weight", "score"]
    return places.select(
        *columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    ).unionByName(
        scores.filter(F.col("n_words") < min_words).select(
            *columns, F.lit(None).cast("long").alias("rank")
        )
    )


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all columns; rows that share an id come together."""
    drawn = rank_by_importance(docs, target, **options).filter("rank is not null")
    ids = drawn.select(F.col("doc_id").alias("_drawn_id"))
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn_id")), "left_semi")
