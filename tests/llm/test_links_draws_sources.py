"""SimHash links, importance resampling and source divergence against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from wayside.llm import simhash_balls as balls
from wayside.llm import source_divergence as divergence
from wayside.llm import target_resampling as resampling
from wayside.llm.common import BLOCK_BYTES, text_blocks, with_row_key

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(LOWER)


def test_blocks_hold_whole_words():
    words = [b"w%d" % n for n in range(200_000)] + [b"x" * (3 * BLOCK_BYTES), b"end"]
    blocks = list(text_blocks(b" ".join(words), re.compile(rb"\S+")))
    assert len(blocks) > 4 and [w for block in blocks for w in block.split()] == words
    assert list(text_blocks(b"", re.compile(rb"\S+"))) == [b""]


# ----------------------------------------------------------------------- simhash


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42)
        for i in range(len(words) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_links(rows, radius=2):
    prints = [(doc_id, brute_fingerprint(text)) for doc_id, text in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for n, (doc_id, _) in enumerate(prints):
        ids[find(n)].append(doc_id)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return Counter((d, f"{p:016x}", least[find(n)]) for n, (d, p) in enumerate(prints))


@pytest.fixture
def chained_rows(words, odd_rows):
    """Texts that differ in a word of many, copies, and unrelated ones."""
    rows = list(odd_rows)
    for base in range(4):
        text = words(f"base-{base}", 400)
        for n in range(12):
            edited = list(text)
            edited[(n * 37) % 400] = f"edit{n}"
            rows.append((100 + 20 * base + n, " ".join(edited)))
    rows += [(300 + n, " ".join(words("same", 50))) for n in range(30)]
    return rows + [(400 + n, " ".join(words(f"other-{n}", 5 + n))) for n in range(40)]


def test_links_equal_brute_force(make_docs, chained_rows):
    found = balls.link_fingerprints(make_docs(chained_rows))
    want = brute_links(chained_rows)
    assert Counter(map(tuple, found.collect())) == want
    assert 20 < len({c for _, _, c in want}) < len(chained_rows) - 50


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_links_connect_what_is_near(llm, radius):
    chosen = random.Random(radius)
    centres = [chosen.getrandbits(64) for _ in range(20)]
    prints = {c for c in centres}
    for centre in centres:
        for _ in range(8):
            flipped = chosen.sample(range(64), chosen.randrange(5))
            prints.add(centre ^ sum(1 << b for b in flipped))
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = balls.near_links(llm.createDataFrame(signed, "print long"), radius).collect()
    values = [p for (p,) in signed]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(r.node != r.other and apart(r.node, r.other) <= radius for r in links)

    def classes(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        members = defaultdict(set)
        for v in values:
            members[find(v)].add(v)
        return set(map(frozenset, members.values()))

    near = [(a, b) for a in values for b in values if a < b and apart(a, b) <= radius]
    assert classes(near) == classes([(r.node, r.other) for r in links])
    assert radius == 0 or near


def test_radius_is_checked(llm):
    with pytest.raises(ValueError):
        balls.near_links(llm.createDataFrame([], "print long"), balls.MAX_RADIUS + 1)


def test_one_variant_meets_no_more_than_a_ball(llm):
    """Many copies of a text are one fingerprint before variants are given out."""
    rows = llm.range(5_000).selectExpr("id as doc_id", "'the same text again' as text")
    found = balls.link_fingerprints(rows)
    assert {(r.component_id, r.fingerprint) for r in found.collect()} == {
        (0, f"{brute_fingerprint('the same text again'):016x}")
    }


def test_long_text_equals_brute_force(words):
    text = "\x0b".join(words("long", 120_000)) + " Éa"
    assert len(text) > 2 * BLOCK_BYTES
    assert balls.fingerprint(text.encode()) == brute_fingerprint(text)


# -------------------------------------------------------------------- resampling

FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_features(text):
    words = re.findall(FEATURE_WORD, lowered(text))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(run.encode()) % 10_000 for run in runs)


def brute_ranks(rows, items, percent=5, min_words=20):
    known = [(doc_id, *brute_features(text)) for doc_id, text in rows]
    s = sum((f for _, _, f in known), Counter())
    t = sum((brute_features(text)[1] for text in items), Counter())
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for doc_id, n_words, features in known:
        weight = sum(n * gain(b) for b, n in features.items())
        name = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, features.total(), weight, weight + noise, n_words])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    found = Counter()
    for place, r in enumerate(able, 1):
        found[(*r[:4], place if place <= drawn else None)] += 1
    found.update((*r[:4], None) for r in out if r[4] < min_words)
    return found


@pytest.fixture
def draw_rows(words, odd_rows):
    rows = list(odd_rows) + [(1_000, "x" * 40 + " " + "é1 " * 30), (1_001, "x" * 400 + " b" * 30)]
    return rows + [(2_000 + n, " ".join(words(f"draw-{n % 60}", 12 + n % 40))) for n in range(160)]


@pytest.mark.parametrize("percent", [5, 40])
def test_ranks_equal_brute_force(llm, make_docs, words, draw_rows, percent):
    items = [" ".join(words(f"draw-{n}", 30)) for n in range(5)] + [None, "", "solo"]
    target = llm.createDataFrame([(n, i) for n, i in enumerate(items)], "item_id long, text string")
    found = resampling.rank_by_importance(make_docs(draw_rows), target, percent=percent)
    assert Counter(map(tuple, found.collect())) == brute_ranks(draw_rows, items, percent)


def test_drawn_rows_keep_their_columns(llm, make_docs, draw_rows):
    docs = make_docs(draw_rows)
    target = llm.createDataFrame([("abcd efgh",)], "text string")
    kept = resampling.resampled(docs, target, percent=10)
    ranks = resampling.rank_by_importance(docs, target, percent=10).filter("rank is not null")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranks.collect()} != set()


def test_runs_of_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(resampling, "JOINED_BYTES", 2_000)
    chosen = random.Random(5)
    texts = [
        " ".join("".join(chosen.choices("abcé XY9.", k=chosen.choice([1, 9, 150, 700]))) for _ in range(n))
        for n in (0, 1, 2, 3, 20, 60)
    ] + ["", "a" * 70_000 + " bb cc " + "d e f " * 60_000]
    found = defaultdict(Counter)
    for _, bucket, text in resampling.feature_blocks([t.encode() for t in texts], 3, 10_000):
        for b, n in zip(bucket.tolist(), text.tolist()):
            found[n][b] += 1
    assert [found[n] for n in range(len(texts))] == [brute_features(t)[1] for t in texts]


def test_ranks_of_many_parts(llm):
    rows = llm.range(2_000).selectExpr("id % 7 as a", "id as b").repartition(9)
    found = resampling.ranked(rows, [rows.a.desc(), rows.b.asc()]).collect()
    want = sorted(((n % 7, n) for n in range(2_000)), key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in found) == list(range(1, 2_001))


# -------------------------------------------------------------------- divergence


def brute_audit(rows, min_docs=3, top=200):
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(term, lowered(text))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        c = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[s][t] for s in sources) for t in kept}
        share = lambda n, of: 1 + 10**9 * (n + 1) // (sum(of.values()) + len(kept))
        p = {s: {t: share(c[s][t], c[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], whole) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if c[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, item, v, n) for n, (v, item) in enumerate(found[:last], 1)}
    return out


@pytest.fixture
def sourced(llm, words):
    """Two languages with sources of very different size; nulls, empty texts, a language
    that keeps no term, groups without terms."""
    chosen = random.Random(11)
    common = words("terms", 80) + ["Größe", "中文", "ABC"]
    rows = [(None, None, None), (None, "a", "1 2 3"), ("xx", "a", "once"), ("xx", None, "only"), ("l1", "empty", "")]
    for n in range(300):
        lang, source = f"l{n % 2}", f"s{min(n % 11, chosen.randrange(11))}"
        skewed = [common[min(int(chosen.expovariate(0.1)), 82)] for _ in range(chosen.randrange(60))]
        rows.append((lang, source, " ".join(skewed)))
    rows += [rows[-1]] * 5
    frame = llm.createDataFrame(
        [(n, *row, "x", 1) for n, row in enumerate(rows)],
        "doc_id long, lang string, source string, text string, term string, n int",
    )
    return rows, frame.repartition(4)


def test_audit_equals_brute_force(sourced):
    rows, docs = sourced
    for top in (200, 3):
        found = [tuple(r) for r in divergence.audit_sources(docs, top=top).collect()]
        assert len(found) == len(set(found)) and set(found) == brute_audit(rows, top=top)


def test_blocks_of_terms_price_alike():
    chosen = np.random.default_rng(3)
    counts = (chosen.zipf(1.4, (700, 9)).clip(0, 10**7) - 1).astype(np.int64)
    totals = counts.sum(axis=0) + len(counts)
    p = divergence.shares(counts + 1, totals[None, :])
    want = [[sum(((p[:, a] - p[:, b]) ** 2 // p[:, b]).tolist()) for b in range(9)] for a in range(9)]
    for columns in (1, 40, 512, 100_000):
        assert divergence.pair_values(counts, totals, columns).tolist() == want


def test_shares_of_large_counts():
    counts = [0, 1, 10**6, 10**13, 8 * 10**15]
    total = 9 * 10**15 - 1
    found = divergence.shares(np.array(counts, np.int64), np.int64(total)).tolist()
    assert found == [1 + 10**9 * c // total for c in counts]


def test_empty_tables(llm, make_docs):
    none = make_docs([])
    assert balls.link_fingerprints(none).count() == 0
    target = llm.createDataFrame([], "text string")
    assert resampling.rank_by_importance(none, target).count() == 0
    assert resampling.rank_by_importance(make_docs([(1, "a b"), (2, None)]), target).count() == 2
    empty = llm.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert divergence.audit_sources(empty).count() == 0


def test_row_keys_outlive_a_shuffle(llm):
    dealt = llm.range(1_000).repartition(7, "id")
    keyed = with_row_key(dealt, "keyed")
    assert "Exchange" not in keyed._jdf.queryExecution().executedPlan().toString()
    assert keyed.select("row_key").distinct().count() == 1_000
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, keyed.coalesce(1).collect()))
