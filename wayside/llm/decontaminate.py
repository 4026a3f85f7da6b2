"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised test items.  Documents are
streamed through it word by word; it keeps the longest suffix that is a substring
of some item, so a window of an item is found in whatever context it stands.
Documents are neither shuffled nor sorted.

Test items are taken in blocks of a bounded number of words.  Each block's
automaton is broadcast, so what executors hold does not grow with the items; one
more block is one more pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import map_batches, stored, text_bytes

# Words of test items in one automaton; an item beyond it is a block of its own.
BLOCK_WORDS = 1 << 17

# Words that count as one quotation; a shorter item counts as a whole.
WINDOW = 13

# A document is contaminated when so many percent of its words are quoted.
MIN_PERCENT = 5

# Slots of the filter on word pairs that occur in items.
PAIR_SLOTS = 1 << 22


def _normal_byte(byte: int) -> int:
    if ord("A") <= byte <= ord("Z"):
        return byte + 32
    word = ord("0") <= byte <= ord("9") or ord("a") <= byte <= ord("z") or byte >= 0x80
    return byte if word else 0x20


# Lower-cases A-Z and blanks everything between words.
NORMAL = bytes(map(_normal_byte, range(256)))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class ItemAutomaton:
    """Substrings of the items as states, and where windows of items end."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for item_id, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item_id, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self._mark(coded)

    def _extend(self, last: int, word: int) -> int:
        """Append a word to the item that ends in state ``last``."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][word]
            fits = self.length[known] == self.length[at] + 1
            self.link[new] = known if fits else self._split(at, word, known)
        return new

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        """A state for the shorter strings of ``known``."""
        short = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[short], self.link[known] = self.link[known], short
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def _mark(self, coded: list[tuple[int | None, list[int]]]) -> None:
        """For every state the windows that end wherever it is reached."""
        ends: dict[int, dict[int, set]] = {}  # state -> window length -> items
        pairs = np.zeros(PAIR_SLOTS, dtype=bool)
        shortest = self.window
        for item_id, ids in coded:
            if not ids:
                continue
            size = min(self.window, len(ids))
            shortest = min(shortest, size)
            state = 0
            for at, word in enumerate(ids):
                state = self.next[state][word]
                if at + 1 >= size:
                    home = state
                    while self.length[self.link[home]] >= size:
                        home = self.link[home]
                    ends.setdefault(home, {}).setdefault(size, set()).add(item_id)
            if len(ids) > 1:
                pairs[self.pair_slot(np.array(ids[:-1]), np.array(ids[1:]))] = True
        self.pairs, self.shortest = pairs, shortest
        # Suffixes of a state are its links: shorter states first.
        self.ends: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((n, frozenset(x)) for n, x in sorted(ends.get(state, {}).items()))
            self.ends[state] = own + self.ends[self.link[state]]

    @staticmethod
    def pair_slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(42)).astype(np.int64)

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges outside which no window can lie: all words, and all pairs of
        neighbours, must occur in items."""
        known = ids >= 0
        if self.shortest > 1:
            if len(ids) < 2:
                return
            known = known[:-1] & known[1:]
            at = np.flatnonzero(known)
            known[at] = self.pairs[self.pair_slot(ids[at], ids[at + 1])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        pair = int(self.shortest > 1)
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start + pair >= self.shortest:
                yield start, end + pair

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit ranges of words, merged and in order, and the items they quote."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        arcs, link, length, ends = self.next, self.link, self.length, self.ends
        spans: list[list[int]] = []
        items: set = set()
        for start, end in self._stretches(ids):
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), start):
                while state and word not in arcs[state]:
                    state = link[state]
                    matched = length[state]
                target = arcs[state].get(word)
                if target is None:
                    continue
                state, matched = target, matched + 1
                for size, found in ends[state]:
                    if size <= matched:
                        items |= found
                        begin = at + 1 - size
                        while spans and spans[-1][0] >= begin:
                            spans.pop()
                        if spans and spans[-1][1] >= begin:
                            spans[-1][1] = at + 1
                        else:
                            spans.append([begin, at + 1])
        return spans, items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), text_bytes().alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row.t))
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    yield block


FOUND = "doc_id long, text_hash long, n_words long, spans array<int>, items array<long>"


def _search_task(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton.value
        for batch in batches:
            counts, ranges, quoted = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                spans, items = tree.search(words)
                counts.append(len(words))
                ranges.append([edge for span in spans for edge in span])
                quoted.append(sorted(i for i in items if i is not None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(ranges, pa.list_(pa.int32())),
                    pa.array(quoted, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return run


def _merge_spans(flat: list[int]) -> list[int]:
    merged: list[int] = []
    for start, end in sorted(zip(flat[::2], flat[1::2])):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _merge_task(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge_spans(s) for s in batch.column("spans").to_pylist()]
            items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
            repeats = [r // blocks for r in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    batch.column("n_words"),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(repeats, pa.int64()),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items", "repeats"],
            )

    return run


def find_quotations(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """What documents quote of the items, one row per document.

    Returns (doc_id, n_words, spans, items): ``spans`` holds start and end, in
    words, of every maximal quoted range; ``items`` the ids of quoted items.  Null
    and empty texts have no words and no hits; repeated rows each get a row; an
    item without an id makes hits but is not listed, items that share an id count
    once.  Without items nothing is hit.
    """
    rows, merged = _quotations(_keyed(docs), benchmark, window, block_words)
    if merged:
        each = F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))
        rows = rows.withColumn("number", each)
    return rows.select("doc_id", "n_words", "spans", "items")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        text_bytes().alias("content"),
    )


def _quotations(
    keyed: DataFrame, benchmark: DataFrame, window: int, block_words: int
) -> tuple[DataFrame, bool]:
    """What is found, and whether equal rows are one row with their number.

    One block of items needs one pass.  With more, each block's finds are stored and
    brought together by id and text, so the driver holds one block at a time.
    """
    context = keyed.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_words)
    found, block, n_blocks = None, next(blocks), 0
    while block is not None:
        automaton = context.broadcast(ItemAutomaton(block, window))
        part = map_batches(keyed, _search_task(automaton), FOUND)
        block, n_blocks = next(blocks, None), n_blocks + 1
        if block is None and found is None:
            return part, False
        part = stored(part, "quotations")
        automaton.destroy()
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"),
        F.count("*").alias("rows"),
    )
    return map_batches(grouped, _merge_task(n_blocks), f"{FOUND}, repeats long"), True


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_percent: int = MIN_PERCENT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``find_quotations`` counted: (doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated); the digest is of the item ids, sorted as strings."""
    found = find_quotations(docs, benchmark, window, block_words)
    lengths = F.expr(
        "aggregate(sequence(0, size(spans) div 2), 0L, (n, i) -> n + "
        "coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0))"
    )
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return (
        found.withColumn("n_hit", lengths)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(listed, 256))
        .withColumn(
            "contaminated",
            (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")),
        )
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    )


def _clean_task(search, place: int, n_columns: int, min_percent: int, cut_words: int | None):
    """``search`` gives (number of words, spans) for each row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text, (n_words, spans) in zip(batch.column(place).to_pylist(), search(batch)):
                hit = sum(end - start for start, end in spans)
                keep.append(not (hit and 100 * hit >= min_percent * n_words))
                if cut_words is not None and spans and keep[-1]:
                    text = cut(text, [s for s in spans if s[1] - s[0] > cut_words])
                texts.append(text)
            columns = list(batch.columns[:n_columns])
            if cut_words is not None:
                columns[place] = pa.array(texts, batch.schema.field(place).type)
            fields = [batch.schema.field(n) for n in range(n_columns)]
            cleaned = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
            yield cleaned.filter(pa.array(keep, pa.bool_()))

    return run


def _by_automaton(automaton, place: int):
    def search(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        tree = automaton.value
        for text in batch.column(place).to_pylist():
            words = words_of((text or "").encode())
            yield len(words), tree.search(words)[0]

    return search


def _by_columns(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
    """The last two columns hold what was found before."""
    for n_words, flat in zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()):
        yield n_words, [list(span) for span in zip(flat[::2], flat[1::2])]


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the given ranges of words; what stands between words stays."""
    raw = text.encode()
    normal = raw.translate(NORMAL)
    edges, at = [], 0
    for word in normal.split():
        start = normal.index(word, at)
        at = start + len(word)
        edges.append((start, at))
    kept, done = [], 0
    for start, end in spans:
        kept.append(raw[done : edges[start][0]])
        done = edges[end - 1][1]
    return (b"".join(kept) + raw[done:]).decode()


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_percent: int = MIN_PERCENT,
    cut_words: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With ``cut_words``, quoted spans of more words are cut from those that stay.  One
    block of items takes one pass and no shuffle; the finds of several blocks are
    joined to the documents.
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    place, width = docs.columns.index("text"), len(docs.columns)
    if second is None:
        search = _by_automaton(context.broadcast(ItemAutomaton(first, window)), place)
        return docs.mapInArrow(_clean_task(search, place, width, min_percent, cut_words), docs.schema)
    found, _ = _quotations(_keyed(docs), benchmark, window, block_words)
    found = found.select(
        F.col("doc_id").alias("_clean_id"),
        F.col("text_hash").alias("_clean_hash"),
        F.col("n_words").alias("_clean_words"),
        F.col("spans").alias("_clean_spans"),
    )
    same = docs["doc_id"].cast("long").eqNullSafe(found["_clean_id"])
    both = docs.join(found, same & (F.xxhash64(docs["text"]) == found["_clean_hash"]))
    rows = both.select(*docs.columns, "_clean_words", "_clean_spans")
    task = _clean_task(_by_columns, place, width, min_percent, cut_words)
    return rows.mapInArrow(task, docs.schema)
