"""How far the sources of a language are from each other, by one-hot level products.

A group is a (language, source).  What a term costs depends on its counts in two groups
only, so a pair of groups is priced from the joint table of their count levels: how many
terms have count ``a`` in one and ``b`` in the other.  For a block of terms, one column
per (group, count level) marks the terms that have it.  The product of these columns
with their transpose holds the joint tables of all pairs of groups at once, in whole
numbers that floats hold exactly.  Terms are sorted by count and blocks halved until
their columns are few, so the many rare terms share large blocks with few levels.

Spark counts terms and deals them out by term; every task prices its own blocks and the
sums of tasks are added.  All arithmetic is in whole numbers of 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.common import ASCII_LOWER_BYTES, map_batches, stored, text_blocks, text_bytes

# Runs of A-Z, a-z and characters beyond ASCII; as UTF-8 bytes, after lower-casing.
TERM = re.compile(rb"[a-z\x80-\xff]+")

# A term is kept by a language with so many documents that hold it.
MIN_DOCS = 3

# Places of a group's report of terms.
TOP_TERMS = 200

# Shares are whole numbers of billionths.
UNIT_DIGITS = 9

# Entries a task counts before it hands them on.
HELD_TERMS = 400_000

# Counts of terms by groups that a task holds, and columns of a block of terms.
HELD_CELLS = 1 << 20
COLUMNS = 512


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * counts / total), by long division in steps that fit 64 bits.

    Exact while counts and totals are below 9 * 10**15 and counts are at most the total.
    """
    digits, rest = np.zeros_like(counts), counts
    for _ in range(UNIT_DIGITS // 3):
        rest = rest * 1000
        digits = digits * 1000 + rest // total
        rest = rest % total
    return digits + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    gap = p - q
    return gap * gap // q


# ------------------------------------------------------------------------ counts

COUNTS = "lang string, source string, term string, n long, docs long"


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term; every group has a row without term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        columns = (batch.column(c) for c in ("lang", "source", "content"))
        for lang, source, content in zip(*columns):
            group = (lang.as_py(), source.as_py())
            n, docs = counts.setdefault(group, (Counter(), Counter()))
            seen: set[bytes] = set()
            for block in text_blocks(content.as_py().translate(ASCII_LOWER_BYTES), TERM):
                words = TERM.findall(block)
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) >= HELD_TERMS:
            yield from _count_rows(counts)
            counts = {}
    yield from _count_rows(counts)


def _count_rows(
    counts: dict[tuple[str, str], tuple[Counter, Counter]],
) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in counts.items():
        terms = [None, *n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(docs[term] for term in n)], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), and a row without term for every group."""

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias

    rows = docs.select(
        named(lang)("lang"), named(source)("source"), text_bytes(text).alias("content")
    )
    return (
        map_batches(rows, _count_task, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def term_vectors(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): the kept terms with their counts by source."""
    return (
        counts.filter("term is not null")
        .groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.collect_list(F.struct("source", "n")).alias("counts"),
        )
        .filter(F.col("docs") >= min_docs)
        .select("lang", "term", "counts")
    )


# ------------------------------------------------------------------------ prices


@dataclass(frozen=True)
class Language:
    """A language's sources, their totals over kept terms, and the number of these."""

    sources: list[str]
    totals: np.ndarray
    n_terms: int

    @property
    def total(self) -> int:
        return int(self.totals.sum()) + self.n_terms


def languages(counts: DataFrame, vectors: DataFrame) -> dict[str, Language]:
    """One row per group comes to the driver: the result has their pairs."""
    groups = counts.filter("term is null").select("lang", "source")
    sums = (
        vectors.select("lang", F.explode("counts").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source"))
        .agg(F.sum("c.n").alias("total"))
    )
    totals = {(r.lang, r.source): r.total for r in sums.collect()}
    n_terms = {r.lang: r.n for r in vectors.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    by_lang: dict[str, list[str]] = {}
    for row in groups.collect():
        by_lang.setdefault(row.lang, []).append(row.source)
    return {
        lang: Language(
            sorted(sources),
            np.array([totals.get((lang, s), 0) for s in sorted(sources)], np.int64),
            n_terms.get(lang, 0),
        )
        for lang, sources in by_lang.items()
    }


def joint_tables(levels: list[np.ndarray], rows: int) -> np.ndarray:
    """The product of the one-hot columns of all groups' levels with their transpose.

    ``levels`` holds, by group, the number of each term's level.
    """
    width = [int(level.max()) + 1 for level in levels]
    marks = np.zeros((rows, sum(width)), np.float32)
    for first, level in zip(np.cumsum([0, *width]), levels):
        marks[np.arange(rows), first + level] = 1
    return marks.T @ marks


def pair_values(counts: np.ndarray, totals: np.ndarray, columns: int = COLUMNS) -> np.ndarray:
    """Sum over terms (rows) of the distance of every group (column) to every other.

    ``totals``: by group, the occurrences of all kept terms plus their number.
    """
    values = np.zeros((counts.shape[1],) * 2, np.int64)
    order = np.argsort(counts.sum(axis=1), kind="stable")
    blocks = [counts[order]]
    while blocks:
        block = blocks.pop()
        found = [np.unique(column, return_inverse=True) for column in block.T]
        width = [len(unique) for unique, _ in found]
        if sum(width) > columns and len(block) > 1:
            half = len(block) // 2
            blocks += [block[:half], block[half:]]
            continue
        joint = joint_tables([level for _, level in found], len(block)).astype(np.int64)
        price = np.concatenate(
            [shares(unique + 1, total) for (unique, _), total in zip(found, totals)]
        )
        priced = joint * distance(price[:, None], price[None, :])
        starts = np.cumsum([0, *width[:-1]])
        values += np.add.reduceat(np.add.reduceat(priced, starts, axis=0), starts, axis=1)
    return values


PRICED = "lang string, source string, part string, item string, value long"


def _price_task(known: dict[str, Language]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        cells: Counter = Counter()
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                part = batch.filter(pc.equal(batch.column("lang"), lang))
                counts = _dense(part.column("counts"), known[lang].sources)
                held.setdefault(lang, []).append((part.column("term"), counts))
                cells[lang] += counts.size
                if cells[lang] >= HELD_CELLS:
                    yield from _priced(lang, known[lang], held.pop(lang), sums)
                    cells[lang] = 0
        for lang in list(held):
            yield from _priced(lang, known[lang], held.pop(lang), sums)
        for lang, values in sums.items():
            sources = known[lang].sources
            mine, other = np.nonzero(~np.eye(len(sources), dtype=bool))
            yield _priced_rows(lang, sources, mine, "pair", sources, other, values[mine, other])

    return run


def _dense(lists: pa.ListArray, sources: list[str]) -> np.ndarray:
    """Terms by sources."""
    counts = np.zeros((len(lists), len(sources)), np.int64)
    items = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(False))
    place = pc.index_in(items.field("source"), value_set=pa.array(sources, pa.string()))
    counts[row, place.to_numpy(False)] = items.field("n").to_numpy(False)
    return counts


def _priced(
    lang: str, known: Language, held: list[tuple[pa.Array, np.ndarray]], sums: dict[str, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """Adds what the terms cost between groups, and gives the terms that a group has
    more often than its language."""
    terms = pa.concat_arrays([term for term, _ in held])
    counts = np.concatenate([count for _, count in held])
    totals = known.totals + known.n_terms
    values = pair_values(counts, totals)
    sums[lang] = sums[lang] + values if lang in sums else values
    p = shares(counts + 1, totals[None, :])
    q = shares(counts.sum(axis=1) + 1, known.total)[:, None]
    term, group = np.nonzero((counts > 0) & (p > q))
    value = distance(p, q)[term, group]
    for at in range(0, len(term), 100_000):
        part = slice(at, at + 100_000)
        yield _priced_rows(lang, known.sources, group[part], "term", terms, term[part], value[part])


def _priced_rows(lang, sources, source_at, part, items, item_at, values) -> pa.RecordBatch:
    def taken(names, at):
        names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
        return names.take(pa.array(at, pa.int64()))

    n = len(values)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * n, pa.string()),
            taken(sources, source_at),
            pa.array([part] * n, pa.string()),
            taken(items, item_at),
            pa.array(values, pa.int64()),
        ],
        ["lang", "source", "part", "item", "value"],
    )


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs``.

    Part ``pair``: the distance to each other source of the language, over all its kept
    terms, all ranks.  Part ``term``: the first ``top`` terms that take a larger share of
    the group than of its language.  Ranks go by value, largest first, then by item in
    the order of its UTF-8 bytes.

    A null text, language or source counts as the empty string.  A group without terms
    takes part with counts of zero, and where a language keeps no term, its pairs have
    the value 0.  A repeated row counts as often as it occurs.  The id is not read.  An
    empty table gives no rows; other columns are ignored.
    """
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    vectors = stored(term_vectors(counts, min_docs), "term-vectors")
    priced = stored(
        map_batches(vectors, _price_task(languages(counts, vectors)), PRICED), "priced"
    )
    groups = counts.filter("term is null").select("lang", "source")
    none = (
        groups.join(groups.withColumnRenamed("source", "item"), "lang")
        .filter("source != item")
        .withColumn("value", F.lit(0).cast("long"))
    )
    keys = ["lang", "source", "item"]
    pairs = (
        priced.filter("part = 'pair'")
        .select(*keys, "value")
        .unionByName(none.select(*keys, "value"))
        .groupBy(*keys)
        .agg(F.sum("value").alias("value"))
    )
    best_first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(best_first)
    terms = priced.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair"))
        .withColumn("rank", rank)
        .select(*columns)
        .unionByName(terms.select(*columns))
    )
