from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayside.llm import components as cc
from wayside.llm import grace_dedup, minhash_join


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        staying = 0
        for doc_id in ids:
            kept = doc_id == keep and not staying
            staying += kept
            out[(doc_id, keep, len(ids), kept, sha)] += 1
    return out


@pytest.mark.parametrize("table_bytes", [1 << 20, 1])
def test_copies_equal_brute_force(make_docs, odd_rows, table_bytes):
    found = grace_dedup.find_copies(make_docs(odd_rows), table_bytes=table_bytes)
    assert Counter(map(tuple, found.collect())) == brute_copies(odd_rows)


def test_spilled_buckets_are_merged():
    texts = [b"%d" % random.Random(n).randrange(300) * 50 for n in range(3_000)]
    records = [(hashlib.sha256(t).digest(), t, n, 1) for n, t in enumerate(texts)]
    found = {t: (keep, n) for _, t, keep, n in grace_dedup.merged(records, table_bytes=4_000)}
    want = {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert found == want


def test_many_tiny_texts_are_spilled(monkeypatch, tmp_path):
    """What entries take counts, not only the few bytes of their contents."""
    tables = []

    class Watched(grace_dedup.ContentTable):
        def __init__(self):
            super().__init__()
            tables.append(self)

    monkeypatch.setattr(grace_dedup, "ContentTable", Watched)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path},{tmp_path}")
    n, bound = 300_000, 8 << 20
    records = ((hashlib.sha256(b"%d" % (i % n)).digest(), b"%d" % (i % n), i, 1) for i in range(2 * n))
    held = largest = 0
    for _, _, keep, members in grace_dedup.merged(records, bound):
        held += 1
        assert members == 2 and keep >= n
        largest = max(largest, max(len(t.entries) for t in tables))
    assert held == n and len(tables) > 16
    assert largest * grace_dedup.ENTRY_BYTES <= bound


def test_spills_go_to_a_folder_of_the_task(monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", "/one,/two")
    assert [grace_dedup.spill_folder(n) for n in range(3)] == ["/one", "/two", "/one"]
    monkeypatch.delenv("SPARK_LOCAL_DIRS")
    assert grace_dedup.spill_folder(3) is None


def test_contents_are_compared_not_digests():
    table = grace_dedup.ContentTable()
    slot, _ = table.find(b"12345678", b"a")
    table.add(slot, (b"12345678", b"a", 1, 1))
    assert table.find(b"12345678x", b"b")[1] == -1
    with pytest.raises(RuntimeError):
        table.find(b"12345678", b"b")


def test_one_copy_stays_with_its_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = grace_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter(
        {(d, t): 1 for d, t in odd_rows if any(k[0] == d and k[3] and k[4] == _sha(t) for k in brute_copies(odd_rows))}
    )
    assert sum(rows.values()) == len({t or "" for _, t in odd_rows})
    assert set(rows) <= set(want) and max(rows.values()) == 1


def _sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_tables(make_docs):
    none = make_docs([])
    assert grace_dedup.find_copies(none).count() == 0
    assert grace_dedup.drop_copies(none).count() == 0
    assert minhash_join.find_near_copies(none).count() == 0


# ------------------------------------------------------------------------- near


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").split() if w]
    size = min(2, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_components(rows):
    sets = [(doc_id, shingles(text)) for doc_id, text in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    order = lambda i: (i is not None, i)
    least = {}
    for n, (doc_id, _) in enumerate(sets):
        r = find(n)
        least[r] = min(least.get(r, doc_id), doc_id, key=order)
    return Counter((d, len(s), least[find(n)]) for n, (d, s) in enumerate(sets))


def edited(words, text, seed, n):
    chosen = random.Random(seed)
    out = list(text)
    for k in range(n):
        out[chosen.randrange(len(out))] = words(f"edit-{seed}-{k}", 1)[0]
    return out


@pytest.fixture
def near_rows(words, odd_rows):
    """Chains, one group with many different members, and unrelated texts."""
    rows = [row for row in odd_rows if row[0] != 6]
    base = words("base", 120)
    for n in range(60):
        rows.append((100 + n, " ".join(edited(words, base, n, n % 9))))
    chain = words("chain", 100)
    for n in range(12):
        rows.append((300 - n, " ".join(chain)))
        chain = edited(words, chain, f"chain-{n}", 4)
    rows += [(400 + n, " ".join(words(f"alone-{n}", 50))) for n in range(20)]
    return rows


def test_components_equal_brute_force(make_docs, near_rows):
    found = minhash_join.find_near_copies(make_docs(near_rows, parts=5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(near_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_signatures_share_a_key():
    chosen = np.random.default_rng(5)
    for _ in range(50):
        a = chosen.integers(0, 1 << 16, minhash_join.SYMBOLS).astype("<u2")
        b = a.copy()
        at = chosen.choice(minhash_join.SYMBOLS, 29, replace=False)
        b[at] ^= 1
        x, y = minhash_join.signature_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def test_symbols_estimate_similarity(words):
    a, b = words("sim", 1000), words("sim", 1000)[:900] + words("other", 100)
    x, y = (minhash_join.shingle_set(" ".join(t).encode()) for t in (a, b))
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    same = (minhash_join.signature(x) == minhash_join.signature(y)).mean()
    assert abs(exact - same) < 0.15


def test_one_document_of_a_group_stays(make_docs, near_rows):
    docs = make_docs([r for r in near_rows if r[0] is not None and r[0] >= 100])
    kept = minhash_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    roots = {c for (_, _, c) in brute_components([r for r in near_rows if r[0] and r[0] >= 100])}
    assert {r.doc_id for r in kept.collect()} == roots


def test_graph_components(llm):
    chosen = random.Random(2)
    links = [(chosen.randrange(300), chosen.randrange(300)) for _ in range(220)]
    links += [(1000 + n, 1001 + n) for n in range(40)] + [(2000, 2000 + n) for n in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    found = cc.components(llm.createDataFrame(links, "node long, other long"))
    assert set(map(tuple, found.collect())) == want


# ------------------------------------------------------- large groups without links


def templated(words, n, shared=0.5, length=60):
    """Texts that share a part of their words with all others and are linked with none."""
    base = words("template", length)
    rows = []
    for i in range(n):
        own = random.Random(i)
        rows.append([w if own.random() < shared else f"own{i}x{k}" for k, w in enumerate(base)])
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block, dealt, few", [(512, 64, 200_000), (16, 64, 0), (16, 2, 200_000)])
def test_blocks_and_keys_find_the_same(make_docs, near_rows, words, monkeypatch, block, dealt, few):
    """Small blocks, groups taken apart into their keys, and rounds without broadcasts."""
    monkeypatch.setattr(cc, "FEW", few)
    monkeypatch.setattr(minhash_join, "BLOCK", block)
    monkeypatch.setattr(minhash_join, "SLICE", block)
    monkeypatch.setattr(minhash_join, "MAX_DEALT", dealt)
    base = words("family", 150)
    rows = list(near_rows) + [
        (5_000 + n, " ".join(edited(words, base, 70 + n, 14 + n % 12))) for n in range(60)
    ]
    found = minhash_join.find_near_copies(make_docs(rows))
    assert Counter(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == (
        brute_components(rows)
    )


def moved_units(llm, words, n, monkeypatch):
    """Rows with signatures, and with texts, that the last step takes for n texts."""
    seen = {}

    def watched(df, label, real=minhash_join.stored):
        kept = real(df, label)
        seen[label] = kept.count()
        return kept

    units = minhash_join._units

    def dealt(rows):
        found = units(rows)
        seen["dealt"] = seen.get("dealt", 0) + found.count()
        return found

    monkeypatch.setattr(minhash_join, "stored", watched)
    monkeypatch.setattr(minhash_join, "_units", dealt)
    rows = llm.createDataFrame(templated(words, n), "doc_id long, text string")
    found = minhash_join.find_near_copies(rows)
    assert found.filter("not kept").count() == 0
    monkeypatch.undo()
    return seen["dealt"], seen["near-units"]


def test_templated_texts_move_in_proportion(llm, words, monkeypatch):
    monkeypatch.setattr(minhash_join, "MAX_DEALT", 4)
    small, _ = moved_units(llm, words, 1_000, monkeypatch)
    monkeypatch.setattr(minhash_join, "MAX_DEALT", 4)
    large, with_texts = moved_units(llm, words, 4_000, monkeypatch)
    assert large <= 2 * 90 * 4_000 and with_texts == 0
    assert large <= 6 * max(small, 4_000)


def test_sets_of_long_texts(words):
    text = "\t".join(words("long", 150_000)).encode()
    assert len(text) > 2 * (1 << 18)
    split = text.split()
    want = np.unique(minhash_join._run_hashes(split, 2))
    assert (minhash_join.shingle_set(text) == want).all()
    assert len(minhash_join.shingle_set(b"")) == 0 and len(minhash_join.shingle_set(b" one ")) == 1
