"""Removal of repeated substrings by distributed prefix doubling.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier.
Strings are ranked by doubling: the rank of a longer string is a pair of ranks of
shorter ones at an offset, and Spark sorts the pairs to see which positions share
them.  Rounds at growing lengths:

* 32 bytes.  Every window of 100 bytes has one seed, the 32-byte string in it with
  the smallest rank, so it is enough to rank one position in some 35.  Neighbouring
  windows with one seed are a stretch.  A seed that occurs once makes all windows of
  its stretch unique, and they are dropped.
* The whole stretch, as the seed's rank paired with the ranks that cover the stretch.
  Equal stretches are past the threshold: all but the first are repeats.
* 100 bytes.  Only the first of the stretches that share a seed but differ are left,
  at the edges of repeats.  They meet again with their bytes; their windows are ranked
  by the pairs of 64-byte ranks at offsets 0 and 36, and sorted; all but the first of
  equal pairs are repeats.

Ranks of up to 64 bytes are 64-bit hashes made by doubling; what is compared is
always at least two of them.  Each task sorts its own rows first and hands on the
first of equals, so a passage that a third of all documents share reaches the
shuffle once per task.  A seed with many different stretches in a task is dealt out
by stretch and not by seed, and later by the rank pairs of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import map_batches, text_bytes

WINDOW = 100
SEED = 32
HALF = 64

# Seeds per window.
SEEDS = WINDOW - SEED + 1

# Bytes of a document that are ranked at once.
SEGMENT = 1 << 19

# Bytes of text after which a task sorts what it has and hands it on.
HELD_BYTES = 24 << 20

# Different stretches of one seed in a task from which on it is dealt by stretch.
MANY_STRETCHES = 16

# The smallest long stands for a null id, as nulls sort first.
NULL_ID = -(1 << 63)

# Rows of the last round that a task sorts at once, if they end with a rank.
CHUNK_ROWS = 20_000

# What the rows of the first round are.
OPEN, SPREAD, REPEAT, MARKER = range(4)

# What is known of a packed run of windows: nothing, that they are repeats, or that
# their seed is dealt out by window.
REPEATED, SPREAD_OUT = 1, 2

# Odd multipliers of the doubling steps.
_FACTORS = [
    np.uint64(x)
    for x in (
        0x9E3779B97F4A7C15,
        0xBF58476D1CE4E5B9,
        0x94D049BB133111EB,
        0xD6E8FEB86659FD93,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0xFF51AFD7ED558CCD,
    )
]
_POSITION = np.uint64((1 << 20) - 1)
_SHIFT = np.uint64(29)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * _FACTORS[6]
    return values ^ (values >> np.uint64(32))


def ranks(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of the strings of 32 and of ``upto`` bytes at every position."""
    names = (data.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]
    size, out = 1, {}
    for factor in _FACTORS:
        if size >= upto:
            break
        pairs = names[:-size] * factor
        pairs += names[size:]
        pairs ^= pairs >> _SHIFT
        names, size = pairs, 2 * size
        if size == SEED or size == upto:
            out[size] = mixed(names)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def seed_places(seeds: np.ndarray) -> np.ndarray:
    """Where the seed of every window is; the leftmost of equal ranks is taken."""
    keys = (seeds & ~_POSITION) | np.arange(len(seeds), dtype=np.uint64)
    return (sliding_minimum(keys, SEEDS) & _POSITION).astype(np.int64)


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, stretch, first window, number of windows) of a segment."""
    named = ranks(data, HALF)
    seeds, halves = named[SEED], named[HALF]
    place = seed_places(seeds)
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate(([0], change))
    windows = np.diff(np.concatenate((first, [len(place)])))
    at = place[first]
    last = first + windows + WINDOW - 1 - HALF
    shape = ((at - first) * 256 + windows).astype(np.uint64)
    stretch = halves[first]
    for more in (halves[(first + last) // 2], halves[last], shape):
        stretch = mixed(stretch * _FACTORS[1] + more)
    return seeds[at], stretch, first, windows


def segments(size: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes whose windows are all windows of the text, each once."""
    for start in range(0, size - WINDOW + 1, SEGMENT):
        yield start, min(size, start + SEGMENT + WINDOW - 1)


def pack(first: np.ndarray, windows: np.ndarray, flags: int) -> np.ndarray:
    """First window, number of windows, and what is known of them."""
    return (first << 22) | (windows << 2) | flags


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 22, (packed >> 2) & ((1 << 20) - 1), packed & 3


ROWS = "deal long, seed long, stretch long, doc_id long, tag int, packed long, state byte"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int8()]
_NAMES = ["deal", "seed", "stretch", "doc_id", "tag", "packed", "state"]


class _Held:
    """Documents of a task with the columns of what was found in them."""

    def __init__(self, width: int) -> None:
        self.ids: list[int] = []
        self.tags: list[int] = []
        self.parts: list[list[np.ndarray]] = [[] for _ in range(width)]
        self.owner: list[np.ndarray] = []
        self.bytes = 0

    def document(self, doc_id: int, tag: int, size: int) -> None:
        self.ids.append(doc_id)
        self.tags.append(tag)
        self.bytes += size

    def add(self, *columns: np.ndarray) -> None:
        for part, column in zip(self.parts, columns):
            part.append(column)
        self.owner.append(np.full(len(columns[0]), len(self.ids) - 1))

    def columns(self) -> tuple[np.ndarray, ...]:
        """(place of the document in the order, doc_id, tag, *columns)"""
        ids, tags = np.array(self.ids, np.int64), np.array(self.tags, np.int64)
        order = np.lexsort((tags, ids))
        new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(tags[order]) != 0)][: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new)
        owner = np.concatenate(self.owner)
        joined = [np.concatenate(part) for part in self.parts]
        return place[owner], ids[owner], tags[owner], *joined


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def merged_runs(place, ids, tags, first, windows) -> tuple[np.ndarray, ...]:
    """Adjacent or overlapping runs of windows of a document as one."""
    order = np.lexsort((first, place))
    place, ids, tags = place[order], ids[order], tags[order]
    first, windows = first[order], windows[order]
    new = _starts(place)
    if len(new) > 1:
        end = first + windows
        # Runs in a document are disjoint or equal, so the last end is the largest.
        new[1:] |= first[1:] > np.maximum(end[:-1], first[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return ids, tags, first, windows
    last = np.maximum.reduceat(first + windows, at)
    # A run longer than a packed number holds is handed on in parts.
    size = last - first[at]
    limit = (1 << 20) - 1
    pieces = -(-size // limit)
    back = np.repeat(np.arange(len(at)), pieces)
    number = np.arange(len(back)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[at][back] + number * limit
    return ids[at][back], tags[at][back], begin, np.minimum(limit, last[back] - begin)


def _first_round(held: _Held, many_stretches: int) -> Iterator[pa.RecordBatch]:
    if not held.owner:
        return
    place, ids, tags, seed, stretch, first, windows = held.columns()
    order = np.lexsort((first, place, stretch, seed))
    place, ids, tags, seed, stretch, first, windows = (
        c[order] for c in (place, ids, tags, seed, stretch, first, windows)
    )
    new_seed = _starts(seed)
    new = new_seed | _starts(stretch)
    group = np.cumsum(new) - 1
    leader = np.flatnonzero(new)[group]
    tie = (place == place[leader]) & (first == first[leader])
    later = ~new & ~tie
    # Different stretches of each seed.
    seed_of = np.cumsum(new_seed[new]) - 1
    many = np.bincount(seed_of) > many_stretches if len(seed_of) else np.empty(0, bool)
    keep = np.flatnonzero(new)
    spread = many[seed_of] if len(seed_of) else np.empty(0, bool)
    names = seed[keep].view(np.int64)
    dealt = np.where(spread, mixed(seed[keep] * _FACTORS[2] + stretch[keep]).view(np.int64), names)
    packed = pack(first[keep], windows[keep], 0)
    state = np.where(spread, SPREAD, OPEN)
    yield from _batches(
        _KINDS, _NAMES, dealt, names, stretch[keep].view(np.int64), ids[keep], tags[keep], packed, state
    )
    # One row tells the other tasks that such a seed has different stretches.
    hot = seed[new_seed][many]
    if len(hot):
        names = hot.view(np.int64)
        none = np.zeros(len(hot), np.int64)
        marks = np.full(len(hot), MARKER)
        yield from _batches(_KINDS, _NAMES, names, names, mixed(hot).view(np.int64), none, none, none, marks)
    ids, tags, first, windows = merged_runs(
        place[later], ids[later], tags[later], first[later], windows[later]
    )
    packed = pack(first, windows, REPEATED)
    unique = mixed(mixed(ids.astype(np.uint64)) + packed.astype(np.uint64)).view(np.int64)
    state = np.full(len(ids), REPEAT)
    yield from _batches(_KINDS, _NAMES, unique, unique, unique, ids, tags, packed, state)


def _batches(kinds, names, *columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[at : at + 100_000]).cast(kind) for c, kind in zip(columns, kinds)], names
        )


def _seed_task(many_stretches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(4)
        for batch in batches:
            for doc_id, tag, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                held.document(doc_id, tag, 0)
                for start, end in segments(len(data)):
                    seed, stretch, first, windows = stretches(data[start:end])
                    held.add(seed, stretch, first + start, windows)
                    held.bytes += end - start
                    if held.bytes >= HELD_BYTES:
                        yield from _first_round(held, many_stretches)
                        held = _Held(4)
                        held.document(doc_id, tag, 0)
        yield from _first_round(held, many_stretches)

    return run


PAIRS = "left_rank long, right_rank long, doc_id long, tag int, packed long, context binary"
_PAIR_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_PAIR_NAMES = ["left_rank", "right_rank", "doc_id", "tag", "packed", "context"]


def _pair_batches(left, right, ids, tags, packed, contexts=None) -> Iterator[pa.RecordBatch]:
    columns = [left, right, ids, tags, packed]
    for at in range(0, len(left), 20_000):
        part = slice(at, at + 20_000)
        size = len(left[part])
        last = pa.nulls(size, pa.binary()) if contexts is None else pa.array(contexts[part], pa.binary())
        arrays = [pa.array(c[part]).cast(kind) for c, kind in zip(columns, _PAIR_KINDS)]
        yield pa.RecordBatch.from_arrays([*arrays, last], _PAIR_NAMES)


def _known(ids, tags, first, windows) -> Iterator[pa.RecordBatch]:
    packed = pack(first, windows, REPEATED)
    unique = mixed(mixed(ids.astype(np.uint64)) + packed.astype(np.uint64)).view(np.int64)
    yield from _pair_batches(unique, tags, ids, tags, packed)


def _sorted_windows(held: _Held) -> tuple[np.ndarray, ...]:
    """Columns in order of the rank pairs, which rows are first of their pair, and
    which come later than that first one."""
    columns = held.columns()
    place, _, _, left, right, first = columns
    order = np.lexsort((first, place, right, left))
    place, ids, tags, left, right, first = (c[order] for c in columns)
    new = _starts(left, right)
    leader = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
    later = ~new & ~((place == place[leader]) & (first == first[leader]))
    return place, ids, tags, left, right, first, new, later


def _spread_rows(held: _Held) -> Iterator[pa.RecordBatch]:
    if not held.owner:
        return
    place, ids, tags, left, right, first, new, later = _sorted_windows(held)
    packed = pack(first[new], np.ones(new.sum(), np.int64), 0)
    yield from _pair_batches(left[new].view(np.int64), right[new].view(np.int64), ids[new], tags[new], packed)
    one = np.ones(later.sum(), np.int64)
    yield from _known(*merged_runs(place[later], ids[later], tags[later], first[later], one))


def _each_window(first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    back = np.repeat(first, windows)
    return back + np.arange(len(back)) - np.repeat(np.cumsum(windows) - windows, windows)


def _edge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held(3)
    for batch in batches:
        for doc_id, tag, text, marks in zip(
            batch.column("doc_id").to_pylist(),
            batch.column("tag").to_pylist(),
            batch.column("content"),
            batch.column("marks"),
        ):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            first, windows, flags = unpack(np.array(marks.values.to_numpy(zero_copy_only=False)))
            known, spread = flags == REPEATED, flags == SPREAD_OUT
            if known.any():
                same = np.zeros(known.sum(), np.int64)
                yield from _known(
                    *merged_runs(same, same + doc_id, same + tag, first[known], windows[known])
                )
            if known.all():
                continue
            held.document(doc_id, tag, 0)
            for start, end in segments(len(data)):
                here = ~known & (first >= start) & (first < start + SEGMENT)
                if not here.any():
                    continue
                named = ranks(data[start:end], HALF)
                some = here & ~spread
                if some.any():
                    seed = named[SEED][seed_places(named[SEED])[first[some] - start]].view(np.int64)
                    same = np.zeros(some.sum(), np.int64)
                    packed = pack(first[some], windows[some], 0)
                    contexts = [
                        data[a : a + n + WINDOW - 1].tobytes()
                        for a, n in zip(first[some].tolist(), windows[some].tolist())
                    ]
                    yield from _pair_batches(seed, same, same + doc_id, same + tag, packed, contexts)
                some = here & spread
                at = _each_window(first[some], windows[some])
                halves = named[HALF]
                held.add(halves[at - start], halves[at - start + WINDOW - HALF], at)
                held.bytes += 64 * len(at)
                if held.bytes >= 2 * HELD_BYTES:
                    yield from _spread_rows(held)
                    held = _Held(3)
                    held.document(doc_id, tag, 0)
    yield from _spread_rows(held)


MARKS = "doc_id long, tag int, packed long"


def _resolve_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known repeats, and the windows that are not the first of their pair.

    Rows come in order of the rank pairs or seeds; equal windows have one of these, so
    they are in one chunk.
    """
    for chunk in _chunks(batches):
        ids = chunk.column("doc_id").to_numpy()
        tags = chunk.column("tag").to_numpy().astype(np.int64)
        packed = chunk.column("packed").to_numpy()
        first, windows, flags = unpack(packed)
        known = flags == REPEATED
        yield from _batches(_PAIR_KINDS[2:5], _PAIR_NAMES[2:5], ids[known], tags[known], packed[known])
        held = _Held(3)
        held.ids, held.tags = ids.tolist(), tags.tolist()
        context = np.array(chunk.column("context").is_valid())
        single = np.flatnonzero(~known & ~context)
        if len(single):
            held.owner.append(single)
            columns = (
                chunk.column("left_rank").to_numpy()[single].view(np.uint64),
                chunk.column("right_rank").to_numpy()[single].view(np.uint64),
                first[single],
            )
            for part, column in zip(held.parts, columns):
                part.append(column)
        rows = np.flatnonzero(context)
        if len(rows):
            texts = chunk.column("context").take(pa.array(rows)).to_pylist()
            halves = ranks(np.frombuffer(b"".join(texts), np.uint8), HALF)[HALF]
            begin = np.cumsum([0, *map(len, texts)])[:-1]
            at = _each_window(begin, windows[rows])
            held.owner.append(np.repeat(rows, windows[rows]))
            where = _each_window(first[rows], windows[rows])
            for part, column in zip(held.parts, (halves[at], halves[at + WINDOW - HALF], where)):
                part.append(column)
        if held.owner:
            place, ids, tags, _, _, first, _, later = _sorted_windows(held)
            one = np.ones(later.sum(), np.int64)
            ids, tags, first, windows = merged_runs(
                place[later], ids[later], tags[later], first[later], one
            )
            packed = pack(first, windows, REPEATED)
            yield from _batches(_PAIR_KINDS[2:5], _PAIR_NAMES[2:5], ids, tags, packed)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in chunks that end where the left rank changes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        left = table.column("left_rank").to_numpy()
        cut = int(np.searchsorted(left, left[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            rest = table.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def removed_ranges(marks: np.ndarray) -> np.ndarray:
    """Maximal removed runs of bytes as rows of start and end."""
    first, windows, _ = unpack(np.sort(marks))
    end = np.maximum.accumulate(first + windows - 1 + WINDOW) if len(first) else first
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(first)])) - 1 if len(at) else at
    return np.stack([first[at], end[last]], axis=1) if len(at) else np.empty((0, 2), np.int64)


RESULT = "doc_id long, kept binary, n_bytes long, removed array<long>"


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, ranges = [], [], []
        for text, marks in zip(batch.column("content"), batch.column("marks").to_pylist()):
            data = text.as_py()
            found = removed_ranges(np.array(marks or [], np.int64))
            parts, done = [], 0
            for start, end in found.tolist():
                parts.append(data[done:start])
                done = end
            kept.append(b"".join(parts) + data[done:])
            sizes.append(len(data))
            ranges.append(found.ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(kept, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(ranges, pa.list_(pa.int64())),
            ],
            ["doc_id", "kept", "n_bytes", "removed"],
        )


def remove_repeats(
    docs: DataFrame, text: str = "text", many_stretches: int = MANY_STRETCHES
) -> DataFrame:
    """(doc_id, kept, n_bytes, removed): the bytes that stay, and the removed ranges.

    ``removed`` holds start and end of every maximal range.  Order is by ``doc_id``,
    null first, then by start.  Rows that share an id are ordered by a hash of their
    text; rows that share id and text are one document that is there several times,
    and are not repeats of each other.  Null texts are empty, texts of fewer than
    100 bytes stay whole, an empty table gives no rows, other columns are ignored.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.hash(text).alias("tag"),
        text_bytes(text).alias("content"),
    )
    seeds = map_batches(keyed, _seed_task(many_stretches), ROWS)
    # The first window is in the high bits of ``packed``.  Both windows have one sort.
    order = ["doc_id", "tag", "packed"]
    of_stretch = Window.partitionBy("deal", "seed", "stretch").orderBy(*order)
    of_seed = (
        Window.partitionBy("deal", "seed")
        .orderBy("stretch", *order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    sorted_pairs = (
        seeds.repartition("deal")
        .withColumn("place", F.rank().over(of_stretch))
        .withColumn("differ", F.min("stretch").over(of_seed) != F.max("stretch").over(of_seed))
        .withColumn("marked", F.max(F.col("state") == MARKER).over(of_seed))
    )
    repeat = (F.col("state") == REPEAT) | (F.col("place") > 1)
    spread = (F.col("state") == SPREAD) | F.col("marked")
    flags = F.when(repeat, REPEATED).when(spread, SPREAD_OUT).otherwise(0).cast("long")
    marks = (
        sorted_pairs.filter((F.col("state") != MARKER) & (repeat | spread | F.col("differ")))
        .withColumn("packed", F.col("packed").bitwiseOR(flags))
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("packed").alias("marks"))
    )
    edges = map_batches(keyed.join(marks, ["doc_id", "tag"]), _edge_task, PAIRS)
    ranked = edges.repartition("left_rank", "right_rank").sortWithinPartitions("left_rank", "right_rank")
    found = (
        map_batches(ranked, _resolve_task, MARKS)
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("packed").alias("marks"))
    )
    cut = map_batches(keyed.join(found, ["doc_id", "tag"], "left"), _cut_task, RESULT)
    return cut.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))


def removal_digest(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    return remove_repeats(docs, text, **options).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.expr("cast(size(removed) div 2 as long)").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
