"""Packing documents into sequences by linear grouping and best fit.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece
lengths, at most ``capacity`` numbers whatever the corpus, is solved on the driver:

1. large lengths, in descending order, are cut into groups of equal cardinality and
   rounded up to the largest of their group;
2. the few rounded sizes make a configuration problem, whose linear programme is
   solved by generating configurations; whole parts of its solution are used;
3. actual lengths take the places of rounded ones; configurations in which rounding
   has left much room are taken apart again;
4. what is left, large or small, is put where it fits best.

The solution is a list of patterns with multiplicities.  Pieces are numbered within
their length by a distributed count, and number and length say at once which place
of which pattern a piece takes; no list of pieces or sequences is ever in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import map_batches, stored
from wayside.llm.pretokens import encoder

CAPACITY = 2048

# Groups of equal cardinality: the sizes of the configuration problem.
GROUPS = 32

# Room that a configuration may have after substitution; one with more is taken
# apart and its lengths are fitted anew.  The limit that needs fewest sequences wins.
ROOMS = (0, 2, 8, 32, 128)

# Lengths up to this part of the capacity are small: they only fill gaps.
SMALL_PART = 16

# Parts in which pieces of one length are numbered, at least, and the pieces of a part
# beyond which there are more.
RANK_PARTS = 64
PART_PIECES = 50_000

END_ID = 0


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that hold pieces of these lengths."""

    lengths: tuple[int, ...]
    times: int


# ------------------------------------------------------------------ the solver


def groups_of(histogram: dict[int, int], small: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths in descending order as groups of (length, count)."""
    large = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if length > small]
    if len(large) <= groups:
        return [[entry] for entry in large]
    total = sum(n for _, n in large)
    out: list[list[tuple[int, int]]] = []
    done = 0
    for length, n in large:
        while n:
            end = -(-total * len(out) // groups) if out else 0
            if done >= end:
                out.append([])
                end = -(-total * len(out) // groups)
            take = min(n, end - done)
            out[-1].append((length, take))
            done, n = done + take, n - take
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        rest = room - sizes
        values = np.where(rest >= 0, best[np.maximum(rest, 0)] + worth, -1.0)
        at = int(values.argmax())
        if values[at] > best[room] + 1e-12:
            best[room], choice[room] = values[at], at
    counts = np.zeros(len(sizes))
    room = capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return best[capacity], counts


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2_000
) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear programme uses each.

    Revised simplex over configurations generated on demand; it starts from one
    configuration for each size, so a basis is always there.
    """
    n = len(sizes)
    columns = [np.eye(n)[i] * (capacity // int(sizes[i])) for i in range(n)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(n)])
    amounts = inverse @ demand
    for step in range(rounds):
        worth = np.ones(n) @ inverse
        value, column = best_configuration(sizes, np.maximum(worth, 0.0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amounts / np.where(able, direction, 1.0), np.inf)
        leaves = int(ratio.argmin())
        columns[leaves] = column
        inverse[leaves] /= direction[leaves]
        others = np.arange(n) != leaves
        inverse[others] -= np.outer(direction[others], inverse[leaves])
        if step % 50 == 49:
            inverse = np.linalg.inv(np.array(columns).T)
        amounts = np.maximum(inverse @ demand, 0.0)
    return [(columns[i], float(amounts[i])) for i in range(n)]


class _Supply:
    """The lengths of a group, handed out in descending order."""

    def __init__(self, entries: list[tuple[int, int]]) -> None:
        self.entries = [list(entry) for entry in reversed(entries)]

    def take(self, n: int) -> list[tuple[int, int]]:
        """``n`` lengths as (length, count); 0 where the group has run out."""
        out = []
        while n and self.entries:
            length, there = self.entries[-1]
            used = min(n, there)
            out.append((length, used))
            n -= used
            if used == there:
                self.entries.pop()
            else:
                self.entries[-1][1] -= used
        return out + [(0, n)] * bool(n)


def substitute(slots: list[list[tuple[int, int]]], times: int) -> Iterator[Pattern]:
    """Patterns of exact lengths from the lengths that fill each slot in turn."""
    at = [0] * len(slots)
    left = [slot[0][1] for slot in slots]
    while times:
        step = min(left)
        lengths = tuple(sorted((s[i][0] for s, i in zip(slots, at) if s[i][0]), reverse=True))
        yield Pattern(lengths, step)
        times -= step
        for number in range(len(slots)):
            left[number] -= step
            if not left[number] and times:
                at[number] += 1
                left[number] = slots[number][at[number]][1]


def best_fit(opened: list[Pattern], rest: dict[int, int], capacity: int) -> list[Pattern]:
    """Put the remaining lengths, in descending order, where the least room is left."""
    by_room: dict[int, list[Pattern]] = {}
    for pattern in opened:
        by_room.setdefault(capacity - sum(pattern.lengths), []).append(pattern)
    done = by_room.pop(0, [])
    rooms = sorted(by_room)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            low = _first_at_least(rooms, length)
            if low == len(rooms):
                each = capacity // length
                full, some = divmod(n, each)
                for pattern in (Pattern((length,) * each, full), Pattern((length,) * some, 1)):
                    if pattern.lengths and pattern.times:
                        _open(by_room, rooms, done, pattern, capacity)
                n = 0
                continue
            room = rooms[low]
            pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[low]
            used = min(n, pattern.times)
            if used < pattern.times:
                _open(by_room, rooms, done, Pattern(pattern.lengths, pattern.times - used), capacity)
            _open(by_room, rooms, done, Pattern((*pattern.lengths, length), used), capacity)
            n -= used
    return done + [pattern for patterns in by_room.values() for pattern in patterns]


def _first_at_least(rooms: list[int], length: int) -> int:
    low, high = 0, len(rooms)
    while low < high:
        middle = (low + high) // 2
        if rooms[middle] < length:
            low = middle + 1
        else:
            high = middle
    return low


def _open(by_room: dict, rooms: list[int], done: list, pattern: Pattern, capacity: int) -> None:
    room = capacity - sum(pattern.lengths)
    if not room:
        done.append(pattern)
        return
    if room not in by_room:
        by_room[room] = []
        rooms.insert(_first_at_least(rooms, room), room)
    by_room[room].append(pattern)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Pattern]:
    """Patterns that hold every length of the histogram as often as it occurs."""
    rest = {length: n for length, n in histogram.items() if n}
    full = rest.pop(capacity, 0)
    patterns = [Pattern((capacity,), full)] if full else []
    small = capacity // SMALL_PART
    grouped = groups_of(rest, small, groups)
    left: dict[int, int] = {length: n for length, n in rest.items() if length <= small}
    opened: list[Pattern] = []
    if grouped:
        sizes = np.array([group[0][0] for group in grouped])
        demand = np.array([sum(n for _, n in group) for group in grouped], dtype=float)
        supplies = [_Supply(group) for group in grouped]
        # Full configurations first: their places are the hardest to fill.
        for counts, amount in configurations(sizes, demand, capacity):
            times = int(amount + 1e-6)
            if times:
                slots = [
                    supplies[g].take(times)
                    for g in np.flatnonzero(counts)
                    for _ in range(int(counts[g]))
                ]
                opened.extend(substitute(slots, times))
        for supply in supplies:
            for length, n in supply.entries:
                left[length] = left.get(length, 0) + n
    tries = (_fit_beyond(opened, left, capacity, room) for room in ROOMS)
    return patterns + min(tries, key=lambda found: sum(p.times for p in found))


def _fit_beyond(
    opened: list[Pattern], left: dict[int, int], capacity: int, room: int
) -> list[Pattern]:
    """Keep configurations with at most ``room``, take the others apart, fit the rest."""
    kept, rest = [], dict(left)
    for pattern in opened:
        if pattern.lengths and capacity - sum(pattern.lengths) <= room:
            kept.append(pattern)
        else:
            for length in pattern.lengths:
                rest[length] = rest.get(length, 0) + pattern.times
    return best_fit(kept, rest, capacity)


# ---------------------------------------------------------------- the Spark side


PIECES = (
    "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"
)


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Whole pieces of ``capacity``; a shorter one comes first."""
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


def _pieces_task(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids, start = encode(text or "") + end, 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((key, doc_id, piece, start, length, crc))
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(
    docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Documents as ids with an end, cut where they are longer than a sequence."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )
    return map_batches(rows, _pieces_task(path, capacity, end_id), PIECES)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For every place of a pattern: the length, the first number of that length that
    it takes, the first sequence, and the offset there."""
    used: dict[int, int] = {}
    sequence = 0
    rows = []
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + pattern.times
            offset += length
        sequence += pattern.times
    rows.sort()
    names = ("length", "first", "sequence", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 4).T))


# A length and a number within it, as one sortable number.
_NUMBER_BITS = 48


def _place_task(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table["length"] << _NUMBER_BITS) + table["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << _NUMBER_BITS) + number, side="right") - 1
            sequence = table["sequence"][at] + number - table["first"][at]
            columns = [batch.column(c) for c in batch.schema.names if c != "number"]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(table["offset"][at])],
                [*names, "sequence_id", "offset"],
            )

    return run


def numbered(pieces: DataFrame, counts: dict[int, int], parts: int) -> DataFrame:
    """``number``: a piece's place among those of its length, from 0.

    A length may hold a third of all pieces, so it is numbered in parts, each from
    the count of the parts before; their number grows with its pieces.
    """
    # A row per length, of which there are as many as a sequence has places.
    split = pieces.sparkSession.createDataFrame(
        [(n, max(parts, -(-count // PART_PIECES))) for n, count in counts.items()],
        "length long, parts long",
    )
    part = F.pmod(F.xxhash64("row_key", "piece"), F.col("parts")).alias("part")
    dealt = pieces.join(F.broadcast(split), "length").select(*pieces.columns, part)
    key = ["length", "part"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    own = Window.partitionBy(*key).orderBy("row_key", "piece")
    return (
        dealt.withColumn("own", F.row_number().over(own))
        .join(starts, key)
        .withColumn("number", F.col("own") - 1 + F.col("before"))
        .drop("own", "before", "part")
    )


def place_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, parts: int = RANK_PARTS
) -> DataFrame:
    """``pieces`` with (sequence_id, offset); they must be stored rows, because they
    are read more than once."""
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {row.length: row.n for row in found}
    patterns = solve(counts, capacity, groups)
    places = pieces.sparkSession.sparkContext.broadcast(_places(patterns))
    schema = f"{PIECES}, sequence_id long, offset long"
    rows = numbered(pieces, counts, parts).select("row_key", "doc_id", "piece", "start", "length", "ids_crc32", "number")
    return map_batches(rows, _place_task(places), schema)


def pack_documents(
    docs: DataFrame,
    path: str,
    text: str = "text",
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    parts: int = RANK_PARTS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are one piece that holds the end id only.  Null ids and
    repeated rows are packed like others; an empty table gives no rows; other columns
    are ignored.
    """
    pieces = stored(token_pieces(docs, path, text, capacity), "token-pieces")
    return place_pieces(pieces, capacity, groups, parts).drop("row_key")
