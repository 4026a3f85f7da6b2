"""Quality from compression: a text is like what compresses it.

Two zstandard dictionaries are trained, from texts labelled good and bad.  A text is
compressed block by block with each; the difference of the two sizes over the text's
size, and the size itself, become a probability by logistic calibration on labelled
texts that the dictionaries have not seen.

Only the fit is bounded: ``Limits`` says how many labelled texts teach, and how many
of their bytes reach the driver for the dictionaries.  Every sampled text has its
share of the bytes: where they do not suffice, the longest give blocks from all over
them instead of all blocks.  The calibration measures sampled texts whole, where they
lie, and weights them to the ratio of all labelled texts, so a score means the same
whatever the sample's bounds and the input's size are.  Scoring reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import id_remainder, map_batches, stored, text_bytes

# Bytes compressed at once: a block is short enough for the dictionary to matter,
# so the difference means the same in short and in long texts.
BLOCK = 1024
LEVEL = 1
DICTIONARY_BYTES = 32 << 10

# A document whose score is below this is rejected.
THRESHOLD = 0.7

# What counts as held out: this remainder of crc32(id) modulo FOLDS.
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class Limits:
    """The bounded sample of labelled texts, for each class."""

    texts: int = 4_000
    bytes: int = 8 << 20


@dataclass(frozen=True)
class Side:
    """The sampled texts of one class as (doc_id, digest, size), and how many labelled
    texts they stand for."""

    texts: list[tuple[int, int, int]]
    total: int


@dataclass(frozen=True)
class Model:
    """What the executors need: two dictionaries and the calibration."""

    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    if dictionary:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=data,
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )


def blocks_of(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, max(1, len(text)), BLOCK)]


def features(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: bytes) -> list[float]:
    """The normalised difference, the compressed share and the length, with their
    products."""
    with_good = with_bad = 0
    for block in blocks_of(text):
        with_good += len(good.compress(block))
        with_bad += len(bad.compress(block))
    size = len(text) + 1
    difference = (with_bad - with_good) / size
    share = np.log((with_good + with_bad) / (2 * size))
    length = np.log(size)
    relative = (with_bad - with_good) / (with_bad + with_good)
    base = [difference, relative, share, length]
    return [
        *base,
        *(x * x for x in base),
        difference * share,
        difference * length,
        share * length,
    ]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.good, self.bad = compressor(model.good), compressor(model.bad)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        rows = np.array([features(self.good, self.bad, text) for text in texts])
        return probability(self.model, rows)


def probability(model: Model, rows: np.ndarray) -> np.ndarray:
    # Features outside what the fit has seen are taken at its edge, so the
    # quadratic terms cannot turn the sign far away from the data.
    scaled = np.clip((rows - model.center) / model.scale, -6, 6)
    # Summed row by row: equal texts have equal scores in whatever batch they come.
    sums = (np.c_[np.ones(len(rows)), scaled] * model.weights).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def calibrate(
    rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, ridge: float = 0.1
) -> tuple[np.ndarray, ...]:
    """Logistic regression by Newton steps: (center, scale, weights).

    A row stands for ``counts`` texts."""
    counts = counts / counts.mean()
    center = np.average(rows, axis=0, weights=counts)
    scale = np.sqrt(np.average((rows - center) ** 2, axis=0, weights=counts)) + 1e-9
    design = np.c_[np.ones(len(rows)), np.clip((rows - center) / scale, -6, 6)]
    weights = np.zeros(design.shape[1])
    penalty = np.full(len(weights), ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(counts * (np.logaddexp(0, z) - labels * z)) + 0.5 * np.sum(penalty * w * w))

    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (counts * (chance - labels)) + penalty * weights
        curve = (design * (counts * chance * (1 - chance))[:, None]).T @ design + np.diag(penalty)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, weights


def train_dictionary(texts: list[bytes]) -> bytes:
    """Empty where there is too little text for a dictionary."""
    samples = [block for text in texts for block in blocks_of(text)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column, limits: Limits) -> list[Side]:
    """The bad and the good texts to learn from, in an order that depends on the ids
    (and the texts of one id) only.

    Ids labelled both ways, null labels and null ids are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .filter("doc_id is not null and quality in (0, 1)")
        .filter(may_learn)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .drop("other")
    )
    # Three numbers a text: its length does not matter here.
    rows = stored(with_digest(docs).drop("content").join(known, "doc_id"), "labelled")
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id", "digest"]
    sides = []
    for side in (0, 1):
        own = rows.filter(F.col("label") == side).select("doc_id", "digest", "size")
        first = own.orderBy(*order).limit(limits.texts).collect()
        sides.append(Side([tuple(r) for r in first], totals.get(side, 0)))
    return sides


def with_digest(docs: DataFrame) -> DataFrame:
    content = text_bytes().alias("content")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), content).select(
        "doc_id",
        F.xxhash64("content").alias("digest"),
        F.length("content").cast("long").alias("size"),
        "content",
    )


def even_share(sizes: list[int], limit: int) -> int:
    """The most bytes that each text may give, so that all give ``limit`` at most."""
    for number, size in enumerate(sorted(sizes)):
        share = limit // (len(sizes) - number)
        if size > share:
            return share
        limit -= size
    return max(sizes, default=0)


def excerpt(text: bytes, share: int) -> bytes:
    """The text, or blocks at even distances where it is longer than ``share``."""
    if len(text) <= share or share == 0:
        return text[:share]
    size = min(BLOCK, share)
    count, every = share // size, -(-len(text) // BLOCK)
    starts = (BLOCK * (n * every // count) for n in range(count))
    return b"".join(text[at : at + size] for at in starts)


def _each_text(function, kind: pa.DataType):
    """Function of (text, share) over rows of (doc_id, digest, share, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = function()
        for batch in batches:
            shares = batch.column(2).to_pylist()
            values = [call(text.as_py(), share) for text, share in zip(batch.column(3), shares)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, kind)], ["doc_id", "digest", "value"]
            )

    return run


def over_sample(docs: DataFrame, sides: list[list[tuple]], shares: list[int], task, schema: str) -> list[list]:
    """What ``task`` makes of the texts of every side, in their order."""
    keys = {(text[0], text[1], share) for side, share in zip(sides, shares) for text in side}
    # At most 2 * limits.texts rows of three numbers: small enough to broadcast.
    chosen = docs.sparkSession.createDataFrame(list(keys), "doc_id long, digest long, share long")
    rows = (
        with_digest(docs)
        .join(F.broadcast(chosen), ["doc_id", "digest"])
        .select("doc_id", "digest", "share", "content")
    )
    made = map_batches(rows, task, f"doc_id long, digest long, value {schema}")
    # Repeated rows are equal: one of them stands for all.
    found = {
        (r.doc_id, r.digest): r.value
        for r in made.dropDuplicates(["doc_id", "digest"]).toLocalIterator()
    }
    return [[found[text[:2]] for text in side] for side in sides]


def excerpts(docs: DataFrame, sides: list[list[tuple]], limits: Limits) -> list[list[bytes]]:
    shares = [even_share([size for *_, size in side], limits.bytes) for side in sides]
    found = over_sample(docs, sides, shares, _each_text(lambda: excerpt, pa.binary()), "binary")
    return [[bytes(text) for text in side] for side in found]


def labelled_texts(
    docs: DataFrame, labels: DataFrame, may_learn: Column, limits: Limits
) -> list[tuple[bytes, int]]:
    """The sample's texts within ``limits``; every sampled text gives its share."""
    sides = [side.texts for side in sample(docs, labels, may_learn, limits)]
    return [(t, label) for label, side in enumerate(excerpts(docs, sides, limits)) for t in side]


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """A model from the labelled documents that are not held out.

    Two thirds of the sample make the dictionaries, the others the calibration.  With
    texts of one class only, or none, the score is the share of good texts (one half
    without any)."""
    may_learn = id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    sides = sample(docs, labels, may_learn, limits)
    bads, goods = (side.texts for side in sides)
    if not goods or not bads:
        share = (sides[1].total + 1) / (sides[0].total + sides[1].total + 2)
        width = len(features(compressor(b""), compressor(b""), b""))
        weights = np.r_[np.log(share / (1 - share)), np.zeros(width)]
        return Model(b"", b"", np.zeros(width), np.ones(width), weights)
    learn = [[t for n, t in enumerate(side) if n % 3] or side for side in (bads, goods)]
    check = [side[::3] for side in (bads, goods)]
    bad, good = map(train_dictionary, excerpts(docs, learn, limits))

    def measure():
        pair = compressor(good), compressor(bad)
        return lambda text, _: features(*pair, text)

    # Measured whole by the executors: a few numbers a text reach the driver.
    task = _each_text(measure, pa.list_(pa.float64()))
    measured = over_sample(docs, check, [0, 0], task, "array<double>")
    rows = np.array([row for side in measured for row in side])
    sizes = [len(side) for side in check]
    stands_for = np.repeat([side.total / size for side, size in zip(sides, sizes)], sizes)
    return Model(good, bad, *calibrate(rows, np.repeat([0.0, 1.0], sizes), stands_for))


def _score_task(model, place: int | None, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value.scorer()
        for batch in batches:
            column = batch.column("content" if place is None else place)
            texts = [t if isinstance(t, bytes) else (t or "").encode() for t in column.to_pylist()]
            scores = scorer.score(texts)
            if place is None:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "score"],
                )
            else:
                yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The score comes from the text alone; null is an empty text and has a score too.
    A null id counts as empty text for the fold.  Repeated rows get a row each,
    an empty table none; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limits))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        text_bytes().alias("content"),
    )
    schema = "doc_id long, held_out boolean, score double"
    return map_batches(rows, _score_task(model, None, None), schema).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), threshold: float = THRESHOLD
) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limits))
    task = _score_task(model, docs.columns.index("text"), threshold)
    return docs.mapInArrow(task, docs.schema)
