"""The classifier against a plain loop, and the pipeline on odd rows and empty tables."""

from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from tests.llm.test_exact_and_near import brute_components
from tests.llm.test_text_operators import brute_quotations, sequences_of

import corpus_pipeline
from wayside.llm import compression_quality as quality
from wayside.llm import license_scan, packing

# ------------------------------------------------------------------ the classifier


def plain_sizes(compressor, text):
    blocks = [text[at : at + quality.BLOCK] for at in range(0, len(text), quality.BLOCK)] or [b""]
    return sum(len(compressor.compress(block)) for block in blocks)


def plain_compressor(texts):
    blocks = [t[at : at + quality.BLOCK] for t in texts for at in range(0, max(1, len(t)), quality.BLOCK)]
    size = min(quality.DICTIONARY_BYTES, sum(map(len, blocks)) // 10)
    try:
        dictionary = zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        dictionary = b"".join(blocks)[-quality.DICTIONARY_BYTES :]
    return zstandard.ZstdCompressor(
        level=quality.LEVEL,
        dict_data=zstandard.ZstdCompressionDict(dictionary),
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )


def plain_row(good, bad, text):
    a, b, size = plain_sizes(good, text), plain_sizes(bad, text), len(text) + 1
    d, s, n = (b - a) / size, math.log((a + b) / (2 * size)), math.log(size)
    base = [d, (b - a) / (a + b), s, n]
    return [*base, *(x * x for x in base), d * s, d * n, s * n]


def plain_scores(rows, labels):
    """Ridge logistic regression by reweighted least squares, nothing shared with the
    library but constants."""
    known = {}
    for doc_id, label in labels:
        known.setdefault(doc_id, set()).add(label)
    texts = {doc_id: (text or "").encode() for doc_id, text in rows}
    place = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
    sides = [
        [texts[i] for i in sorted(known, key=place) if i in texts and known[i] == {side}
         and zlib.crc32(str(i).encode()) % 4 != 2]
        for side in (0, 1)
    ]
    bad, good = (plain_compressor([t for n, t in enumerate(side) if n % 3]) for side in sides)
    check = [[plain_row(good, bad, t) for t in side[::3]] for side in sides]
    x = np.array(check[0] + check[1])
    y = np.repeat([0.0, 1.0], [len(check[0]), len(check[1])])
    weight = np.repeat([len(s) / len(c) for s, c in zip(sides, check)], [len(c) for c in check])
    weight = weight / weight.mean()
    center = (weight[:, None] * x).sum(0) / weight.sum()
    scale = np.sqrt((weight[:, None] * (x - center) ** 2).sum(0) / weight.sum()) + 1e-9
    shaped = lambda r: np.c_[np.ones(len(r)), np.clip((np.array(r) - center) / scale, -6, 6)]
    design, ridge = shaped(x), np.r_[1e-6, np.full(x.shape[1], 0.1)]
    w = np.zeros(design.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-design @ w))
        v = weight * np.maximum(p * (1 - p), 1e-12)
        target = design @ w + weight * (y - p) / v
        left = np.r_[np.sqrt(v)[:, None] * design, np.diag(np.sqrt(ridge))]
        new = np.linalg.lstsq(left, np.r_[np.sqrt(v) * target, np.zeros(len(w))], rcond=None)[0]
        w = w + 0.5 * (new - w)
    return {i: 1 / (1 + math.exp(-float((shaped([plain_row(good, bad, t)]) @ w)[0]))) for i, t in texts.items()}


def test_scores_equal_a_plain_loop(llm, make_docs, words):
    chosen = random.Random(4)
    vocabulary = [words("good", 300), words("bad", 300)]
    rows, labels = [(900, None), (901, "")], []
    for n in range(260):
        side = n % 2
        mixed = [chosen.choice(vocabulary[side ^ (chosen.random() < 0.3)]) for _ in range(20 + n)]
        rows.append((n, " ".join(mixed)))
        if n < 200:
            labels.append((n, 1 - side))
    labels += [(3, 1), (3, 0), (4_000, 1)]  # labelled both ways, and without a document
    frame = llm.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.score_quality(make_docs(rows), frame).collect()}
    want = plain_scores(rows, labels)
    assert set(found) == set(want)
    for doc_id, score in want.items():
        assert found[doc_id].score == pytest.approx(score, abs=2e-5), doc_id
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
    assert len({round(s, 2) for s in want.values()}) > 20


# --------------------------------------------------------------------- the pipeline


def written(llm, folder, docs, items, labels):
    docs.write.parquet(folder + "/documents.parquet")
    llm.createDataFrame(items, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder


def test_odd_rows_go_through_all_stages(llm, make_docs, odd_rows, words, folder):
    base = words("near", 80)
    items = [(1, " ".join(words("item", 15))), (2, None), (3, "")]
    rows = list(odd_rows) + [
        (20, " ".join(base)),
        (21, " ".join(base[:79])),
        (22, items[0][1]),
        (23, " ".join(words("long one", 600)) + " " + items[0][1]),
    ]
    # Labels of one class only: the score is that class's share, so all documents stay.
    labels = [(n, 1, 0) for n in range(60)]
    docs = make_docs([(d, t) for d, t in rows] + [(n, f"filler {n}") for n in range(30, 60)])
    sf_dir = written(llm, folder, docs, items, labels)
    docs = llm.read.parquet(sf_dir + "/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(llm, kept, sf_dir).checkpoint()
        assert kept.columns == docs.columns, name
        assert kept.filter("kept = 'x' and node = 'x'").count() == kept.count()
    # Equal texts: the largest id; then near ones: the smallest; then quotations.
    largest = {}
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        old = largest.get(text or "", (None,))[0]
        largest[text or ""] = (doc_id if old is None else old if doc_id is None else max(old, doc_id),)
    alone = [(i, t) for t, (i,) in largest.items()]
    near = {d for (d, _, root), _ in brute_components(alone).items() if d == root}
    want = set()
    for doc_id, text in alone:
        n_words, n_hit, _ = brute_quotations(text, items)
        if doc_id in near and not (n_hit and 20 * n_hit >= n_words):
            want.add((doc_id, text))
    assert {(r.doc_id, r.text or "") for r in kept.collect()} == want
    assert 20 in near and 21 not in near and 22 not in {d for d, _ in want} and 23 in {d for d, _ in want}
    pieces = corpus_pipeline.run(llm, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in want}
    sequences_of(pieces, packing.CAPACITY)


def test_an_empty_table_goes_through_all_stages(llm, make_docs, folder):
    none = make_docs([])
    sf_dir = written(llm, folder, none, [(1, "x y z")], [(1, 1, 0)])
    docs = llm.read.parquet(sf_dir + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(llm, docs, sf_dir)
        assert docs.columns == none.columns and docs.count() == 0
    assert corpus_pipeline.run(llm, sf_dir).count() == 0


def test_empty_labels_and_items(llm, make_docs, folder):
    sf_dir = written(llm, folder, make_docs([(1, "a b c"), (2, None)]), [], [])
    assert corpus_pipeline.run(llm, sf_dir).count() == 0  # one half is below the threshold
    docs = llm.read.parquet(sf_dir + "/documents.parquet")
    assert corpus_pipeline.STAGES[3][1](llm, docs, sf_dir).count() == 2


# ------------------------------------------------------------------------ licences


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for n, y in enumerate(b, 1):
            row[n] = before[n - 1] + 1 if x == y else max(row[n - 1], before[n])
    return row[-1]


def test_places_and_coverage_of_edited_notices(llm, make_docs, words):
    """Notices between words that no template has: the place is where the notice stands,
    the words aligned are a longest common subsequence by the plain table."""
    names = ["MIT", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "Unlicense"]
    templates = {n: license_scan.TEMPLATES[n] for n in names if n in license_scan.TEMPLATES}
    rows, want = [], {}
    for number, (name, text) in enumerate(templates.items()):
        whole = license_scan.words_of(text.encode())
        for variant in range(4):
            chosen = random.Random(10 * number + variant)
            kept = [w for w in whole if variant == 0 or chosen.random() > 0.04 * variant]
            edited = []
            for w in kept:
                edited.append(w.decode())
                if variant > 1 and chosen.random() < 0.05:
                    edited += words(f"zz{variant}", 1 + chosen.randrange(3))
            before, after = words("front", 7 * variant), words("back", 40)
            doc_id = 10 * number + variant
            rows.append((doc_id, " ".join([*before, *edited, *after])))
            got = longest_common([w.encode() for w in edited], whole)
            if 100 * got >= license_scan.MIN_PERCENT * len(whole):
                own = [n for n, w in enumerate(edited) if w.encode() in set(whole)]
                place = (len(before) + own[0], len(before) + own[-1] + 1)
                want[doc_id, name] = (*place, got, got / len(whole))
    found = license_scan.scan_licenses(make_docs(rows), templates).collect()
    own = {(r.doc_id, r.license): tuple(r)[2:] for r in found if (r.doc_id, r.license) in want}
    assert own == want and len(want) >= 12
    assert {r.license for r in found} == set(templates)
