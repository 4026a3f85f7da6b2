"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles has a signature of ``SYMBOLS`` MinHash symbols of
16 bits.  The signature is split into chunks.  By the pigeonhole principle two
signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have a chunk
that differs in at most ``ERRORS``; all ways to leave so many symbols of a chunk out
are enumerated as keys, so such a pair shares a key.

A key may be shared by a third of all documents, so pairs within a key are never
listed.  Documents with equal sets are one node first.  Then

1. every task joins the nodes of a key to the first of them it has seen, and these
   first ones meet by a shuffle: nodes that share keys make groups;
2. nodes with near signatures to such a first one are confirmed on the full sets, and
   confirmed links make components;
3. in groups with more than one component, the nodes outside the largest one are
   compared with all nodes of the group, by blocks.  Signatures and sizes go first; only
   nodes that are near to one of another component there go on with their texts, and
   are compared on full sets with an inverted index.  Only links between components
   come out; pairs within a component need no test.  A group that would take many
   blocks is taken apart into its keys, so that what is moved grows with its nodes.

So every pair that shares a key is confirmed, refuted or in one component.  The last
step is quadratic where many nodes of one key are near to its others but linked with
none; no pairs are emitted or shuffled for that, only blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
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

# Signatures that differ in up to CHUNKS * (ERRORS + 1) - 1 = 29 symbols share a key.
# Sets with a similarity of 0.8 differ in 18 of 90 symbols, with a deviation of 3.8.
CHUNKS = 15
CHUNK = 6
ERRORS = 1
SYMBOLS = CHUNKS * CHUNK

# Pairs that share a key and differ in more symbols are not looked at: more than five
# deviations from what a similarity of 0.8 gives.
MAX_DISTANCE = 38

# Words of a shingle, and the least similarity in percent.
SHINGLE = 2
PERCENT = 80

# Nodes whose keys a task holds before it hands them on.
HELD_NODES = 20_000

# Shingles hashed at once.
SHINGLE_BLOCK = 4_096

# Words a worker remembers the hashes of; the memo is emptied when full.
MEMO_WORDS = 400_000

# The smallest long stands for a null id, as nulls sort first.
NULL_ID = -(1 << 63)

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ORDER = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer words than a shingle are one."""
    words: list[bytes] = []
    parts = []
    for block in text_blocks(text.translate(ASCII_LOWER_BYTES), SPACE_WORD):
        words += block.split()
        if len(words) >= shingle:
            parts.append(np.unique(_run_hashes(words, shingle)))
            words = words[len(words) - shingle + 1 :]
    if not parts:
        return _run_hashes(words, len(words))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _run_hashes(words: list[bytes], size: int) -> np.ndarray:
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return hashes
    joined = np.full(len(words) - size + 1, size, np.uint64)
    for at in range(size):
        joined = mixed(joined * _ORDER + hashes[at : len(hashes) - size + 1 + at])
    return joined


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash symbols of a set that is not empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SHINGLE_BLOCK):
        block = np.multiply.outer(_FACTORS, shingles[at : at + SHINGLE_BLOCK])
        block += _ADDENDS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """For every signature its keys: each chunk with each symbol left out."""
    terms = mixed((signatures.astype(np.uint64) + np.uint64(1)) * _PLACES)
    chunks = terms.reshape(len(signatures), CHUNKS, CHUNK)
    sums = chunks.sum(axis=2, dtype=np.uint64)[:, :, None] - chunks
    salts = np.arange(SYMBOLS, dtype=np.uint64).reshape(CHUNKS, CHUNK) * _ORDER
    return mixed(sums + salts).reshape(len(signatures), SYMBOLS)


# -------------------------------------------------------------------- documents


FEATURES = "doc_id long, n_shingles long, digest binary, signature binary"


def _feature_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column("content"):
                shingles = shingle_set(text.as_py(), shingle)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return run


def document_features(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        text_bytes(text).alias("content"),
    )
    return map_batches(rows, _feature_task(shingle), FEATURES)


# ------------------------------------------------------------------------- keys


KEYS = "deal long, key long, node long, hub long, alone boolean"


def _key_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, signatures, held = [], [], 0
    for batch in batches:
        nodes.append(batch.column("node").to_numpy(zero_copy_only=False))
        signatures.extend(batch.column("signature").to_pylist())
        held += batch.num_rows
        if held >= HELD_NODES:
            yield from _key_rows(np.concatenate(nodes), signatures)
            nodes, signatures, held = [], [], 0
    if held:
        yield from _key_rows(np.concatenate(nodes), signatures)


def _key_rows(nodes: np.ndarray, signatures: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of the first node of each key, and of the others with it as their hub."""
    symbols = np.frombuffer(b"".join(signatures), "<u2").reshape(len(nodes), SYMBOLS)
    keys = signature_keys(symbols).view(np.int64).ravel()
    owner = np.repeat(nodes, SYMBOLS)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    hubs = owner[starts][np.cumsum(new) - 1]
    alone = np.diff(np.r_[starts, len(keys)]) == 1
    # A node that has met its hub needs no one else, so it is dealt out by itself.
    deal = np.where(new, keys, mixed(owner.view(np.uint64) + keys.view(np.uint64)).view(np.int64))
    single = np.zeros(len(keys), bool)
    single[starts] = alone
    for at in range(0, len(keys), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[part]) for c in (deal, keys, owner, hubs, single)],
            ["deal", "key", "node", "hub", "alone"],
        )


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, hub) for every node of every key that at least two nodes have.

    Following hubs, all nodes of a key are connected.
    """
    rows = map_batches(nodes.select("node", "signature"), _key_task, KEYS).repartition("deal")
    # Rows of a key in different tasks are its first nodes there: one a task.
    of_key = Window.partitionBy("deal", "key")
    return (
        rows.withColumn("least", F.min("hub").over(of_key))
        .withColumn("n", F.count("*").over(of_key))
        .filter("n > 1 or not alone or node != hub")
        .select("key", "node", F.least("least", "hub").alias("hub"))
    )


# ------------------------------------------------------------------------ pairs


def _near_task(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                for c in ("left_signature", "right_signature")
            )
            near = (left != right).sum(axis=1) <= max_distance
            yield batch.filter(pa.array(near)).select(["node", "other"])

    return run


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, max_distance: int) -> DataFrame:
    """The pairs whose signatures and sizes allow the similarity."""
    left = nodes.select(
        "node", F.col("signature").alias("left_signature"), F.col("n_shingles").alias("left_n")
    )
    right = nodes.select(
        F.col("node").alias("other"),
        F.col("signature").alias("right_signature"),
        F.col("n_shingles").alias("right_n"),
    )
    sized = (
        pairs.join(left, "node")
        .join(right, "other")
        .filter(100 * F.least("left_n", "right_n") >= percent * F.greatest("left_n", "right_n"))
        .select("node", "other", "left_signature", "right_signature")
    )
    return map_batches(sized, _near_task(max_distance), "node long, other long")


def _confirm_task(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            similar = []
            for a, other, b in zip(
                batch.column("left_text"), batch.column("other").to_pylist(), batch.column("right_text")
            ):
                left = shingle_set(a.as_py(), shingle)
                if other != last or right is None:
                    last, right = other, shingle_set(b.as_py(), shingle)
                common = len(np.intersect1d(left, right, assume_unique=True))
                similar.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.filter(pa.array(similar, pa.bool_())).select(["node", "other"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    left = texts.select("node", F.col("content").alias("left_text"))
    right = texts.select(F.col("node").alias("other"), F.col("content").alias("right_text"))
    both = pairs.join(left, "node").join(right, "other").select("node", "other", "left_text", "right_text")
    return map_batches(both, _confirm_task(shingle, percent), "node long, other long")


def _text_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [
                xxhash.xxh3_128_digest(shingle_set(text.as_py(), shingle).tobytes()) == digest
                for text, digest in zip(batch.column("content"), batch.column("digest").to_pylist())
            ]
            yield batch.filter(pa.array(same, pa.bool_())).select(["node", "content"])

    return run


def star_pairs(shared: DataFrame) -> DataFrame:
    """For every node the hub that most of its keys have, and the smallest hub."""
    counted = (
        shared.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    )
    chosen = counted.groupBy("node").agg(
        F.max(F.struct("n", "hub")).alias("most"), F.min("hub").alias("least")
    )
    hubs = F.array_distinct(F.array("most.hub", "least"))
    return chosen.select("node", F.explode(hubs).alias("other"))


# Nodes outside a group's largest component that a task holds, and nodes it compares
# with them.
BLOCK = 512
SLICE = 512

# Times a node of a group may be dealt out before the group is taken apart into its keys,
# of which a node has SYMBOLS.
MAX_DEALT = 64

UNIT = ["group", "block", "slice"]


def _sized(known: DataFrame) -> DataFrame:
    """The rows (node, group, root) of groups with several roots, with the group's
    largest component ``main`` and the numbers of its ``blocks`` and ``slices``."""
    sizes = known.groupBy("group", "root").agg(F.count("*").alias("n"))
    several = (
        sizes.groupBy("group")
        .agg(
            F.max(F.struct("n", "root")).alias("top"),
            F.sum("n").alias("n"),
            F.count("*").alias("n_roots"),
        )
        .filter("n_roots > 1")
        .select(
            "group",
            F.col("top.root").alias("main"),
            F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("blocks"),
            F.ceil(F.col("n") / SLICE).alias("slices"),
        )
    )
    # Dealt out by another hash, both sides of the join are plain shuffles that can be split.
    return known.join(several.repartition(F.xxhash64("group")), "group")


def open_groups(nodes: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, group, root, main, blocks, slices) of groups with several components."""
    known = (
        nodes.join(groups.withColumnRenamed("root", "group"), "node", "left")
        .join(roots, "node", "left")
        .select("node", F.coalesce("group", "node").alias("group"), F.coalesce("root", "node").alias("root"))
    )
    return _sized(known)


def _units(opened: DataFrame) -> DataFrame:
    """(group, block, slice, compared, node, root): each node outside the main component
    in a block of its own, for every slice, and every node in a slice, for every block."""
    outside = opened.filter("root != main").select(
        "group",
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
        F.lit(False).alias("compared"),
        "node",
        "root",
    )
    everyone = opened.select(
        "group",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).alias("slice"),
        F.lit(True).alias("compared"),
        "node",
        "root",
    )
    return outside.unionByName(everyone)


def _gathered(rows: DataFrame) -> DataFrame:
    """Each unit in one task, its block first."""
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "compared")


class _Held:
    """Nodes with their roots, sizes, signatures and, where asked for, keys."""

    def __init__(self, batches: list[pa.RecordBatch], with_keys: bool) -> None:
        self.rows = pa.Table.from_batches(batches).combine_chunks()
        number = lambda name: self.rows[name].to_numpy()
        self.roots, self.sizes = number("root"), number("n_shingles")
        joined = b"".join(self.rows["signature"].to_pylist())
        self.signatures = np.frombuffer(joined, "<u2").reshape(-1, SYMBOLS)
        self.keys = signature_keys(self.signatures).view(np.int64) if with_keys else None

    def chosen(self, at: np.ndarray) -> pa.RecordBatch:
        kept = self.rows.select([*UNIT, "compared", "node", "root"]).take(pa.array(at))
        return kept.combine_chunks().to_batches()[0]


def _near(block: _Held, others: _Held, key: int | None, percent: int, most: int) -> tuple:
    """Places of nodes of either side that are near to one of another root on the other.

    With ``key``, a pair is taken only where this is the smallest key it shares.
    """
    differ = np.zeros((len(block.roots), len(others.roots)), np.uint8)
    for left, right in zip(block.signatures.T, others.signatures.T):
        differ += left[:, None] != right[None, :]
    small = np.minimum(block.sizes[:, None], others.sizes[None, :])
    large = np.maximum(block.sizes[:, None], others.sizes[None, :])
    near = (differ <= most) & (100 * small >= percent * large)
    left, right = np.nonzero(near & (block.roots[:, None] != others.roots[None, :]))
    if key is not None and len(left):
        own = np.zeros(len(left), bool)
        for at in range(0, len(left), 65_536):
            part = slice(at, at + 65_536)
            mine, theirs = block.keys[left[part]], others.keys[right[part]]
            shared = np.where(mine == theirs, mine, np.iinfo(np.int64).max)
            own[part] = shared.min(axis=1) == key
        left, right = left[own], right[own]
    return np.unique(left), np.unique(right)


def _near_unit_task(by_key: bool, percent: int, max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, block, found = None, [], None, np.empty(0, np.int64)
        for batch in batches:
            parts = [batch.column(c).to_numpy(False) for c in (*UNIT, "compared")]
            change = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if start == end:
                    continue
                rows = batch.slice(start, end - start)
                here = tuple(int(p[start]) for p in parts[:3])
                if here != unit:
                    if block is not None and len(found):
                        yield block.chosen(found)
                    unit, waiting, block, found = here, [], None, np.empty(0, np.int64)
                if not parts[3][start]:
                    waiting.append(rows)
                    continue
                if block is None and waiting:
                    block = _Held(waiting, by_key)
                if block is not None:
                    others = _Held([rows], by_key)
                    key = unit[0] if by_key else None
                    left, right = _near(block, others, key, percent, max_distance)
                    found = np.union1d(found, left)
                    if len(right):
                        yield others.chosen(right)
        if block is not None and len(found):
            yield block.chosen(found)

    return run


UNITS = "group long, block long, slice long, compared boolean, node long, root long"


def near_units(
    opened: DataFrame, shared: DataFrame, nodes: DataFrame, percent: int, max_distance: int
) -> DataFrame:
    """The rows of units with nodes that are near to one of another component there."""
    features = nodes.select("node", "signature", "n_shingles")

    def near(rows: DataFrame, by_key: bool) -> DataFrame:
        units = _gathered(_units(rows).join(features, "node"))
        return map_batches(units, _near_unit_task(by_key, percent, max_distance), UNITS)

    many = F.col("blocks") + F.col("slices") > MAX_DEALT
    large = opened.filter(many)
    of_groups = near(opened.filter(~many), False)
    if large.isEmpty():
        return of_groups
    of_keys = large.select("node", "root").join(shared.select("node", "key"), "node")
    by_key = _sized(of_keys.select("node", F.col("key").alias("group"), "root"))
    return of_groups.unionByName(near(by_key, True))


def _cross_task(shingle: int, percent: int):
    """Links between a block of nodes and the nodes that follow it, by an inverted
    index of the block; one link for two components is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index, met = None, [], None, set()
        for batch in batches:
            found = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "block", "slice")))
            rows = zip(keys, *(batch.column(c).to_pylist() for c in ("compared", "node", "root", "content")))
            for key, compared, node, root, content in rows:
                if key != unit:
                    unit, held, index, met = key, [], None, set()
                shingles = shingle_set(content, shingle)
                if not compared:
                    held.append((node, root, shingles))
                    continue
                if not held:
                    continue
                if index is None:
                    index = _Index(held)
                for place in index.similar(shingles, percent).tolist():
                    other, other_root, _ = held[place]
                    pair = (min(root, other_root), max(root, other_root))
                    if root != other_root and pair not in met:
                        met.add(pair)
                        found.append((node, other))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], ["node", "other"]
            )

    return run


class _Index:
    """Which sets of a block hold each shingle."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]) -> None:
        self.sizes = np.array([len(shingles) for _, _, shingles in held])
        everything = np.concatenate([shingles for _, _, shingles in held])
        owner = np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(everything, kind="stable")
        self.shingles, self.starts = np.unique(everything[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(everything))
        self.owner = owner[order]

    def similar(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        at = at[self.shingles[at] == shingles]
        parts = [self.owner[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]
        if not parts:
            return np.empty(0, np.int64)
        common = np.bincount(np.concatenate(parts), minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(shingles) - common))


def cross_links(units: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components, each unit by itself."""
    rows = _gathered(units.join(texts, "node"))
    return map_batches(rows, _cross_task(shingle, percent), "node long, other long")


def find_near_copies(
    docs: DataFrame,
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked when their sets of distinct shingles have a similarity of
    ``percent`` or more, components are what links connect, and ``component_id`` is the
    smallest id of the component.  Texts without words, or null, have an empty set and
    are linked with nothing.  A null id is smaller than any other.  Rows that share an
    id are one node of the graph: they are in one component.  An empty table gives no
    rows; other columns are ignored.
    """
    features = stored(document_features(docs, text, shingle), "features")
    nodes = stored(
        features.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
            F.count("*").alias("copies"),
        ),
        "nodes",
    )
    shared = stored(shared_keys(nodes), "shared-keys")
    live = shared.select("node").unionByName(shared.select(F.col("hub").alias("node"))).distinct()
    wanted = nodes.join(live, "node", "left_semi").select("node", "digest")
    texts = stored(
        map_batches(
            docs.select(
                F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("node"),
                text_bytes(text).alias("content"),
            ).join(wanted, "node"),
            _text_task(shingle),
            "node long, content binary",
        ),
        "live-texts",
    )

    near = near_pairs(star_pairs(shared), nodes, percent, max_distance)
    first = stored(confirmed(stored(near, "star-pairs"), texts, shingle, percent), "star-links")
    groups = components(shared.select("node", F.col("hub").alias("other")))
    opened = stored(open_groups(texts.select("node"), groups, components(first)), "open-groups")
    units = stored(near_units(opened, shared, nodes, percent, max_distance), "near-units")
    second = stored(cross_links(units, texts, shingle, percent), "cross-links")
    roots = components(first.unionByName(second))
    return _members(features, nodes, roots)


def _members(features: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    # Only nodes that stand for others, or are linked, need a row here.
    classes = (
        nodes.join(roots, "node", "left")
        .filter("root is not null or copies > 1")
        .select("digest", F.coalesce("root", "node").alias("component"))
    )
    back: Column = F.nullif(F.col("component_id"), F.lit(NULL_ID))
    return (
        features.select("doc_id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .withColumn(
            "component_id",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")),
        )
        .select(
            F.nullif(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"),
            "n_shingles",
            back.alias("component_id"),
            (F.col("doc_id") == F.col("component_id")).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all columns."""
    stay = find_near_copies(docs, text, **options).filter("kept").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_stay_id")
    )
    keyed = docs.withColumn("_stay_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return keyed.join(stay, "_stay_id", "left_semi").drop("_stay_id")
