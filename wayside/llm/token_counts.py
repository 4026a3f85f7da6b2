"""Token counts without token ids.

Pieces are counted once for each distinct pre-token of the corpus.  A document's
count is the sum over its pre-tokens, each with its frequency there.  The most
frequent pre-tokens, of a fixed number, are broadcast with their counts; the
documents' other pre-tokens join the counts by a shuffle.  So no task and no
broadcast grows with the vocabulary, and few rows are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import map_batches, stored, with_row_key
from wayside.llm.pretokens import PreTokenizer, is_plain, pretokenizer

# Pre-tokens in the broadcast table: some 20 bytes each, whatever the corpus.
FREQUENT = 200_000

# Distinct chunks of text a task holds before it hands on what it has counted.
HELD_CHUNKS = 500_000

# Entries of a task's memo of chunks; it is emptied when full.
MEMO_CHUNKS = 200_000

# Steps per doubling in the histogram that finds the most frequent pre-tokens.
STEPS = 8

LIMIT = 2048


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [text or "" for text in batch.column(column).to_pylist()]


def frequencies(pre: PreTokenizer, text: str) -> tuple[int, Counter, Counter]:
    """(special tokens, white-space chunks, pre-tokens outside the chunks)."""
    if is_plain(text) and not pre.special.search(text):
        return 0, Counter(text.split()), Counter()
    parts, specials = pre.split_specials(text)
    return len(specials), Counter(), Counter(p for part in parts for p in pre.by_library(part))


def _vocabulary_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(path)
        chunks, pretokens = Counter(), Counter()
        for batch in batches:
            for text in _texts(batch, "text"):
                _, some, others = frequencies(pre, text)
                chunks.update(some)
                pretokens.update(others)
                if len(chunks) + len(pretokens) >= HELD_CHUNKS:
                    yield from _counted(pre, chunks, pretokens)
                    chunks, pretokens = Counter(), Counter()
        yield from _counted(pre, chunks, pretokens)

    return run


def _counted(pre: PreTokenizer, chunks: Counter, pretokens: Counter) -> Iterator[pa.RecordBatch]:
    for chunk, n in chunks.items():
        for pretoken in pre.of_chunk(chunk):
            pretokens[pretoken] += n
    names, counts = list(pretokens), list(pretokens.values())
    for at in range(0, len(names), 20_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[at : at + 20_000]), pa.array(counts[at : at + 20_000], pa.int64())],
            ["pretoken", "frequency"],
        )


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, frequency) over all texts."""
    rows = docs.select(F.col(text).alias("text"))
    counted = map_batches(rows, _vocabulary_task(path), "pretoken string, frequency long")
    return counted.groupBy("pretoken").agg(F.sum("frequency").alias("frequency"))


def _pieces_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(path)
        for batch in batches:
            pieces = [pre.count(p) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int32())], ["pretoken", "frequency", "pieces"]
            )

    return run


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(pretoken, frequency, pieces): every distinct pre-token is tokenized once."""
    return map_batches(words, _pieces_task(path), "pretoken string, frequency long, pieces int")


def _step():
    return F.floor(F.log2("frequency") * STEPS)


def frequent_step(pieces: DataFrame, most: int) -> int:
    """The lowest histogram step from which on at most ``most`` pre-tokens lie."""
    histogram = pieces.groupBy(_step().alias("step")).agg(F.count("*").alias("n")).collect()
    held, lowest = 0, 1 << 30
    for row in sorted(histogram, key=lambda r: -r.step):
        held += row.n
        if held > most:
            break
        lowest = row.step
    return lowest


def _documents_task(path: str, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = pretokenizer(path), dict(zip(*_columns(frequent.value)))
        memo: dict[str, tuple[int, tuple]] = {}

        def of_chunk(chunk: str) -> tuple[int, tuple]:
            parts = pre.of_chunk(chunk)
            rare = tuple(p for p in parts if p not in known)
            found = sum(known[p] for p in parts if p in known), rare
            if len(memo) >= MEMO_CHUNKS:
                memo.clear()
            memo[chunk] = found
            return found

        for batch in batches:
            keys, ids, sizes, tokens, names, times = [], [], [], [], [], []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                total, chunks, others = frequencies(pre, text)
                rare: Counter = Counter()
                for chunk, n in chunks.items():
                    count, unknown = memo.get(chunk) or of_chunk(chunk)
                    total += n * count
                    for pretoken in unknown:
                        rare[pretoken] += n
                for pretoken, n in others.items():
                    if pretoken in known:
                        total += n * known[pretoken]
                    else:
                        rare[pretoken] += n
                # The first row carries what is known; without rare pre-tokens its
                # name is the key of the row, which is nobody's pre-token.
                rows = list(rare.items()) or [(f" {key}", 0)]
                keys.extend([key] * len(rows))
                ids.extend([doc_id] * len(rows))
                sizes.extend([len(text.encode())] + [0] * (len(rows) - 1))
                tokens.extend([total] + [0] * (len(rows) - 1))
                names.extend(name for name, _ in rows)
                times.extend(n for _, n in rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array(times, pa.int64()),
                ],
                ["row_key", "doc_id", "n_bytes", "tokens", "pretoken", "times"],
            )

    return run


def _columns(table: bytes) -> list[list]:
    with pa.ipc.open_stream(table) as reader:
        return [column.to_pylist() for column in reader.read_all().columns]


def _serialized(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, frequent: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for every row of ``docs``.

    Counts are those of the library for the vocabulary at ``path``: no tokens are
    added, a special token's string inside a text is that token.  Null and empty
    texts have no tokens.  Null ids and repeated rows are counted like others; an
    empty table gives no rows; other columns are ignored.
    """
    pieces = stored(count_pieces(vocabulary(docs, path, text), path), "pieces")
    step = frequent_step(pieces, frequent)
    head = pieces.filter(_step() >= step).select("pretoken", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(_serialized(head))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = with_row_key(given, "texts").select("row_key", "doc_id", "text")
    parts = map_batches(
        rows,
        _documents_task(path, known),
        "row_key long, doc_id long, n_bytes long, tokens long, pretoken string, times long",
    )
    rare = pieces.filter(_step() < step).select("pretoken", "pieces")
    return (
        parts.join(rare, "pretoken", "left")
        .withColumn("tokens", F.col("tokens") + F.col("times") * F.coalesce("pieces", F.lit(0)))
        .groupBy("row_key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_bytes").alias("n_bytes"),
            F.sum("tokens").alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
