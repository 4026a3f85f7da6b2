"""Scoring texts with a language model: context-tree weighting over bytes.

The model is what the training texts hold: how often every gram of six bytes and
every word occurs.  The counts are summed by a shuffle and stored; each group of
contexts makes its trees in one task, and only the nodes of depths 0 to 2, whose number
the bytes bound and not the corpus, pass through the driver.

A text's score is the sum over its grams.  The most frequent grams and words, of a
fixed number, are broadcast with their values; all others join theirs by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm import ctw
from wayside.llm.common import (
    ASCII_LOWER_BYTES,
    BLOCK_BYTES,
    SPACE_WORD,
    id_remainder,
    map_batches,
    stored,
    text_blocks,
    text_bytes,
    with_row_key,
)

# What counts as held out: this remainder of crc32(id) modulo FOLDS.
FOLDS, HELD_OUT = 7, 2

# Grams and words in the broadcast table: some 20 bytes each, whatever the corpus.
FREQUENT_GRAMS = 1 << 19
FREQUENT_WORDS = 400_000

# Bytes of text after which a task sums up its grams and words, and sums after which it
# hands them on.
HELD_BYTES = 8 << 20
HELD_KEYS = 1_500_000

# Bytes and pieces of text that are scored at once; a piece's number and a gram's key
# share 63 bits.
SCORED_BYTES = 1 << 20
SCORED_PIECES = 10_000
KEY_BITS = 8 * (ctw.DEPTH + 1)

# Keys that a task turns into trees at once, if the groups end there.
TREE_KEYS = 500_000

# Steps per doubling in the histogram that finds the most frequent keys.
STEPS = 8

# A key is a gram's number or a word; a leading byte tells them apart.
GRAM, WORD = b"g", b"w"
END_WORD = b" "

COUNTS = "key binary, total long, learned long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER_BYTES).split()


def segments(text: bytes) -> Iterator[tuple[bytes, bytes, bytes, bool]]:
    """A text by pieces of bounded size: (bytes before, piece, words, is it the last).

    ``words`` are whole words, each with one of the pieces.
    """
    at = 0
    for block in text_blocks(text, SPACE_WORD):
        for start in range(at, max(at + len(block), 1), 2 * BLOCK_BYTES):
            end = min(start + 2 * BLOCK_BYTES, at + len(block))
            words = block if start == at else b""
            yield text[max(start - ctw.DEPTH, 0) : start], text[start:end], words, end == len(text)
        at += len(block)


def gram_names(keys: np.ndarray) -> pa.Array:
    """Six big-endian bytes: in order, keys with one context stand together."""
    raw = np.empty((len(keys), 1 + ctw.DEPTH + 1), np.uint8)
    raw[:, :1] = np.frombuffer(GRAM, np.uint8)
    raw[:, 1:] = keys.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 2:]
    ends = np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(raw)]
    )


def gram_numbers(names: pa.Array) -> np.ndarray:
    if not len(names):
        return np.zeros(0, np.int64)
    _, ends, raw = names.buffers()
    ends = np.frombuffer(ends, np.int32)[names.offset : names.offset + len(names) + 1]
    padded = np.zeros((len(names), 8), np.uint8)
    padded[:, 2:] = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].reshape(len(names), -1)[:, 1:]
    return padded.view(">i8").ravel().astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs; sorts in place."""
    values.sort()
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.diff(np.r_[starts, len(values)])


class _Sums:
    """Counts by key, handed on when too many different keys are held."""

    def __init__(self, names) -> None:
        self.names, self.held, self.rows = names, [], 0

    def add(self, keys, total: np.ndarray, learned: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(pa.table([pa.array(keys), total, learned], ["key", "total", "learned"]))
        self.rows += len(total)
        if self.rows >= HELD_KEYS:
            self._merge()
            if self.rows >= HELD_KEYS // 2:
                yield from self.flush()

    def _merge(self) -> None:
        groups = pa.concat_tables(self.held).group_by("key", use_threads=False)
        sums = groups.aggregate([("total", "sum"), ("learned", "sum")])
        self.held = [sums.rename_columns(["key", "total", "learned"])]
        self.rows = sums.num_rows

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        for batch in self.held[0].to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays(
                [self.names(batch.column(0)), *batch.columns[1:]], batch.schema.names
            )
        self.held, self.rows = [], 0


class _Counted:
    """Grams and words of the texts a task has seen, learned ones apart."""

    def __init__(self) -> None:
        self.gram_sums = _Sums(lambda keys: gram_names(keys.to_numpy()))
        self.word_sums = _Sums(lambda words: pc.binary_join_element_wise(WORD, words, b""))
        self._clear()

    def _clear(self) -> None:
        self.grams: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.words: dict[bool, list[pa.Array]] = {True: [], False: []}
        self.bytes = 0

    def add(self, before: bytes, piece: bytes, words: bytes, last: bool, learn: bool) -> None:
        self.grams[learn].append(ctw.gram_keys(piece, before, last))
        self.words[learn].append(pa.array([*words_of(words), *[END_WORD] * last], pa.binary()))
        self.bytes += len(piece) + 1

    def sum_up(self) -> Iterator[pa.RecordBatch]:
        for learn in (True, False):
            if self.grams[learn]:
                keys, counts = runs(np.concatenate(self.grams[learn]))
                yield from self.gram_sums.add(keys, counts, counts * learn)
                words, counts = pa.chunked_array(self.words[learn]).value_counts().flatten()
                yield from self.word_sums.add(words, counts.to_numpy(), counts.to_numpy() * learn)
        self._clear()

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.sum_up()
        yield from self.gram_sums.flush()
        yield from self.word_sums.flush()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted = _Counted()
    for batch in batches:
        for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
            for piece in segments(text.as_py()):
                counted.add(*piece, learn)
                if counted.bytes >= HELD_BYTES:
                    yield from counted.sum_up()
    yield from counted.flush()


def count_keys(docs: DataFrame) -> DataFrame:
    """(key, total, learned) of (content, learn) rows: occurrences in all texts and in
    those that may be learned from."""
    rows = docs.select("content", "learn")
    return (
        map_batches(rows, _count_task, COUNTS)
        .groupBy("key")
        .agg(F.sum("total").alias("total"), F.sum("learned").alias("learned"))
    )


# ------------------------------------------------------------------- the trees


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts in order, cut where the three latest context bytes change."""
    keys, counts, size = [], [], 0
    for batch in batches:
        keys.append(gram_numbers(batch.column("key")))
        counts.append(batch.column("learned").to_numpy(zero_copy_only=False))
        size += len(keys[-1])
        if size >= TREE_KEYS:
            held, held_counts = np.concatenate(keys), np.concatenate(counts)
            group = held >> (8 * (ctw.DEPTH + 1 - ctw.GROUP_DEPTH))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield held[:cut], held_counts[:cut]
                keys, counts, size = [held[cut:]], [held_counts[cut:]], len(held) - cut
    if size:
        yield np.concatenate(keys), np.concatenate(counts)


def _trees(keys: np.ndarray, counts: np.ndarray) -> dict[int, ctw.Level]:
    learned = counts > 0
    return ctw.build_levels(keys[learned], counts[learned].astype(float), ctw.GROUP_DEPTH)


def _top_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts in _groups(batches):
        level = _trees(keys, counts)[ctw.GROUP_DEPTH]
        parent = ((level.nodes >> 16) << 8) | (level.nodes & 0xFF)
        columns = ctw.summed(parent, level.zeros, level.ones, level.log_p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["node", "zeros", "ones", "children"]
        )


def _predict_task(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _groups(batches):
            levels = {**_trees(keys, counts), **top.value}
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [gram_names(part), pa.array(ctw.predict(levels, part))],
                    ["key", "value"],
                )

    return run


def gram_values(grams: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of a gram's last byte after the others."""
    group = F.substring("key", 1, 1 + ctw.GROUP_DEPTH)
    ordered = grams.select("key", "learned").repartition(group).sortWithinPartitions("key")
    nodes = (
        map_batches(ordered, _top_task, "node long, zeros double, ones double, children double")
        .groupBy("node")
        .agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children")))
        .toArrow()
    )
    columns = [nodes.column(c).to_numpy() for c in ("node", "zeros", "ones", "children")]
    top = grams.sparkSession.sparkContext.broadcast(ctw.top_levels(*columns))
    return map_batches(ordered, _predict_task(top), "key binary, value double")


# ---------------------------------------------------------------- scoring texts


class Lookup:
    """Values of numbers in an open-addressing table, for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4 - 1).bit_length() if len(keys) else 4)
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits)
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            # The first that claims a free slot has it; the others move on.
            free = self.keys[slots[left]] < 0
            claim, which = np.unique(slots[left[free]], return_index=True)
            winners = left[free][which]
            self.keys[claim], self.values[claim] = keys[winners], values[winners]
            left = np.setdiff1d(left, winners)
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); values are 0 where a key is not there."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = held == keys
        values = np.where(found, self.values[slots], 0.0)
        left = np.flatnonzero(~found & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            values[left[hit]] = self.values[slots[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (held >= 0)]
        return values, found


PARTS = (
    "row_key long, doc_id long, held_out boolean, bytes long, tokens long, known long, "
    "base double, score double, key binary, times long"
)


def _score_task(frequent, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_scores, words, counts = frequent.value
        scores = np.log10(counts + 1) - np.log10(total + distinct + 1)
        scorer = _Scorer(Lookup(gram_keys, gram_scores), words, scores)
        for batch in batches:
            for key, doc_id, held_out, text in zip(*batch.columns):
                row = (key.as_py(), doc_id.as_py(), held_out.as_py())
                for piece in segments(text.as_py()):
                    scorer.add(row, *piece)
                    if scorer.bytes >= SCORED_BYTES or len(scorer.rows) >= SCORED_PIECES:
                        yield from scorer.parts()
        yield from scorer.parts()

    return run


class _Scorer:
    """Pieces of texts, and what is known of them without the rare keys."""

    def __init__(self, grams: Lookup, words: list[bytes], scores: np.ndarray) -> None:
        self.grams, self.known = grams, dict(zip(words, range(len(words))))
        # The last one is that of a word that is not there.
        self.scores = np.append(scores, 0.0)
        self._clear()

    def _clear(self) -> None:
        self.rows, self.keys, self.words, self.bytes = [], [], [], 0

    def add(self, row: tuple, before: bytes, piece: bytes, words: bytes, last: bool) -> None:
        self.rows.append((*row, len(piece)))
        self.keys.append(ctw.gram_keys(piece, before, last))
        self.words.append([*words_of(words), *[END_WORD] * last])
        self.bytes += len(piece) + 1

    def parts(self) -> Iterator[pa.RecordBatch]:
        """A row for each piece, and one for each rare key of a piece."""
        if not self.rows:
            return
        row_key, doc_id, held_out, size = zip(*self.rows)
        count = len(self.rows)
        lengths = [len(k) for k in self.keys]
        keys = np.concatenate(self.keys)
        values, found = self.grams.find(keys)
        score = np.add.reduceat(values, np.cumsum([0, *lengths[:-1]]))
        left = np.flatnonzero(~found)
        # A rare gram's number with its piece's above it.
        rare = (np.repeat(np.arange(count), lengths)[left] << KEY_BITS) | keys[left]
        rare, gram_times = runs(rare)

        words = list(chain.from_iterable(self.words))
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        owner = np.repeat(np.arange(count), [len(w) for w in self.words])
        tokens = np.bincount(owner, minlength=count)
        n_known = np.bincount(owner[place >= 0], minlength=count)
        base = np.bincount(owner, self.scores[place], minlength=count)
        left = np.flatnonzero(place < 0)
        rare_words = Counter(zip(owner[left].tolist(), (words[i] for i in left)))

        # A piece's own row has a key of its own, which is nobody's.
        own = [b"-%d" % key for key in row_key]
        columns = [row_key, doc_id, held_out, size, tokens, n_known, base, score, own, np.zeros(count, int)]
        yield _part(columns)

        owners = np.r_[rare >> KEY_BITS, np.fromiter((o for o, _ in rare_words), np.int64, len(rare_words))]
        names = pa.concat_arrays(
            [
                gram_names(rare & ((1 << KEY_BITS) - 1)),
                pa.array([WORD + word for _, word in rare_words], pa.binary()),
            ]
        )
        times = np.r_[gram_times, np.fromiter(rare_words.values(), np.int64, len(rare_words))]
        owners = np.array(row_key, np.int64)[owners]
        for at in range(0, len(owners), 50_000):
            part = slice(at, at + 50_000)
            n = len(owners[part])
            none = [np.zeros(n, int)] * 3 + [np.zeros(n)] * 2
            yield _part([owners[part], [None] * n, [None] * n, *none, names[part], times[part]])
        self._clear()


def _part(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, _PART_KINDS)], _PART_NAMES
    )


_PART_KINDS = [
    pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
    pa.float64(), pa.float64(), pa.binary(), pa.int64(),
]
_PART_NAMES = [
    "row_key", "doc_id", "held_out", "bytes", "tokens", "known", "base", "score", "key", "times",
]


def _is(kind: bytes):
    return F.substring("key", 1, 1) == F.lit(kind)


def _step(column: str):
    return F.floor(F.log2(F.col(column) + 1) * STEPS)


def _frequent_step(keys: DataFrame, column: str, most: int) -> int:
    """The lowest histogram step from which on at most ``most`` keys lie."""
    histogram = keys.groupBy(_step(column).alias("step")).agg(F.count("*").alias("n")).collect()
    held, lowest = 0, 1 << 30
    for row in sorted(histogram, key=lambda r: -r.step):
        held += row.n
        if held > most:
            break
        lowest = row.step
    return lowest


def score_texts(
    docs: DataFrame,
    text: str = "text",
    frequent_grams: int = FREQUENT_GRAMS,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """Every text scored by a model of those that are not held out.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte), one row per row of ``docs``: ``score`` is the model's log10
    probability of the text with its end, ``bits_per_byte`` its code length over the
    bytes and the end, ``base_score`` that of a smoothed model of single words.  A null
    text is empty: one token, its end.  A null id counts as empty text for the fold.
    Repeated rows are learned from and scored like others; if nothing may be learned,
    every bit has probability one half.  An empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    given = docs.select("doc_id", F.col(text).alias("text"))
    rows = with_row_key(given, "texts").select(
        "row_key",
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        text_bytes("text").alias("content"),
    )
    counts = stored(count_keys(rows.withColumn("learn", ~F.col("held_out"))), "counts")
    words = counts.filter(_is(WORD) & (F.col("learned") > 0))
    seen = words.agg(F.coalesce(F.sum("learned"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grams = counts.filter(_is(GRAM))
    scores = stored(gram_values(grams), "gram-values")

    gram_step = _frequent_step(grams, "total", frequent_grams)
    word_step = _frequent_step(words, "learned", frequent_words)
    often = grams.filter(_step("total") >= gram_step).select("key")
    top_grams = scores.join(often, "key").toArrow()
    top_words = words.filter(_step("learned") >= word_step).select("key", "learned").toArrow()
    frequent = context.broadcast(
        (
            gram_numbers(pa.concat_arrays([pa.array([], pa.binary()), *top_grams.column("key").chunks])),
            top_grams.column("value").to_numpy(),
            [w[1:] for w in top_words.column("key").to_pylist()],
            top_words.column("learned").to_numpy(),
        )
    )

    parts = map_batches(rows, _score_task(frequent, seen.n, seen.v), PARTS)
    rare_words = words.filter(_step("learned") < word_step)
    values = scores.unionByName(
        rare_words.select("key", F.col("learned").cast("double").alias("value"))
    )
    scale = F.log10(F.lit(float(seen.n + seen.v + 1)))
    value = F.coalesce("value", F.lit(0.0))
    word_base = F.when(_is(WORD), F.col("times") * (F.log10(value + 1) - scale)).otherwise(0.0)
    word_known = F.when(_is(WORD) & F.col("value").isNotNull(), F.col("times")).otherwise(0)
    gram_score = F.when(_is(GRAM), F.col("times") * value).otherwise(0.0)
    return (
        parts.join(values, "key", "left")
        .groupBy("row_key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("bytes").alias("n_bytes"),
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + word_known).alias("n_known"),
            F.sum(F.col("base") + word_base).alias("base_score"),
            F.sum(F.col("score") + gram_score).alias("score"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(seen.n).cast("long").alias("train_tokens"),
            "base_score",
            "score",
            (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )
