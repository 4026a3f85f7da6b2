from __future__ import annotations

import difflib
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from wayside.llm import (
    chat_windows,
    decontaminate,
    license_scan,
    packing,
    pretokens,
    suffix_dedup,
    token_counts,
)

# ------------------------------------------------------------------ suffix removal


def brute_removal(rows):
    """By definition, over all windows of 100 bytes; ids must be distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        runs = sum(1 for n in range(len(gone)) if gone[n] and (n == 0 or not gone[n - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def removal(docs, **options):
    found = suffix_dedup.removal_digest(docs, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


@pytest.fixture
def repeating_rows(words):
    chosen = random.Random(7)
    passage, base = " ".join(words("passage", 60)), " ".join(words("base", 700))
    rows = [(n, " ".join(words(f"d{n}", 20)) + passage + " ".join(words(f"e{n}", 30))) for n in range(25)]
    for n in range(30, 55):
        start = chosen.randrange(2_000)
        rows.append((n, base[start : start + chosen.randrange(90, 800)] + "z" * chosen.choice([0, 99, 350])))
    return [*rows, (60, None), (61, ""), (62, "short"), (None, passage), (63, "ab" * 200)]


@pytest.mark.parametrize("many", [0, 2, 1_000])
def test_removed_bytes_equal_brute_force(make_docs, repeating_rows, many):
    got = removal(make_docs(repeating_rows, parts=4), many_stretches=many)
    assert got == brute_removal(repeating_rows)


def test_repeated_rows_are_one_document(make_docs, words):
    text, other = " ".join(words("r", 100)), " ".join(words("s", 100))
    rows = [(1, text), (1, text), (2, text), (3, other), (3, other)]
    found = suffix_dedup.remove_repeats(make_docs(rows, parts=1)).collect()
    got = Counter((r.doc_id, bytes(r.kept)) for r in found)
    assert got == {(1, text.encode()): 2, (2, b""): 1, (3, other.encode()): 2}


def test_long_texts_are_ranked_in_segments(make_docs):
    chosen = random.Random(3)
    long = "".join(chosen.choices("abcdefghij", k=3 * suffix_dedup.SEGMENT // 2))
    edge = suffix_dedup.SEGMENT
    rows = [(1, long), (2, "x" * 30 + long[edge - 300 : edge + 300] + "y" * 30), (3, long)]
    got = removal(make_docs(rows, parts=2))
    assert got[1][1] == 0 and got[3][1] == len(long)
    assert got[2][1] == 600 and got[2][2] == 1


def test_no_documents(make_docs):
    assert suffix_dedup.removal_digest(make_docs([])).count() == 0


# ----------------------------------------------------------------- decontamination


def brute_quotations(text, items, window=13):
    words = decontaminate.words_of((text or "").encode())
    hit, quoted = set(), set()
    for item_id, item in items:
        parts = decontaminate.words_of((item or "").encode())
        size = min(window, len(parts))
        wanted = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in wanted:
                hit |= set(range(at, at + size))
                quoted.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in quoted if i is not None)


@pytest.fixture
def items(words):
    rows = [(n, " ".join(words(f"item{n}", 30))) for n in range(6)]
    return [
        *rows,
        (10, "short test item"),
        (11, "Solo"),
        (12, None),
        (13, "... !!"),
        (14, rows[0][1][40:]),
        (None, "no id here"),
    ]


@pytest.fixture
def quoting_rows(words, odd_rows, items):
    chosen = random.Random(11)
    rows = list(odd_rows)
    for n in range(40):
        text = words(f"doc{n}", chosen.choice([5, 60, 400]))
        item = chosen.choice(items)[1] or ""
        part = item.split()[chosen.randrange(5) :][: chosen.choice([3, 12, 13, 14, 40])]
        at = chosen.randrange(len(text))
        rows.append((100 + n, " ".join(text[:at] + [p.upper() for p in part] + text[at:]) + " short test, ITEM"))
    return rows


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_hits_equal_brute_force(llm, make_docs, quoting_rows, items, block_words):
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(make_docs(quoting_rows), benchmark, block_words=block_words)
    want = Counter()
    for doc_id, text in quoting_rows:
        n_words, n_hit, quoted = brute_quotations(text, items)
        digest = hashlib.sha256(",".join(quoted).encode()).hexdigest()
        want[(doc_id, n_words, n_hit, len(quoted), digest, n_hit > 0 and 20 * n_hit >= n_words)] += 1
    assert Counter(map(tuple, found.collect())) == want


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_contaminated_documents_go(llm, make_docs, quoting_rows, items, block_words):
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    docs = make_docs(quoting_rows)
    kept = decontaminate.drop_contaminated(docs, benchmark, block_words=block_words)
    assert kept.columns == docs.columns
    want = Counter()
    for row in quoting_rows:
        n_words, n_hit, _ = brute_quotations(row[1], items)
        want[row] += not (n_hit and 20 * n_hit >= n_words)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == +want


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_long_spans_are_cut(llm, make_docs, words, items, block_words):
    lead, tail = ", ".join(words("lead", 400)), "; ".join(words("tail", 400))
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, f"{lead}. {items[0][1]} ({tail}) short test item")])
    row = decontaminate.drop_contaminated(docs, benchmark, cut_words=5, block_words=block_words).first()
    assert row.text == f"{lead}.  ({tail}) short test item"


def test_no_items_no_documents(llm, make_docs, odd_rows):
    none = llm.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(make_docs(odd_rows), none).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(make_docs([]), none).count() == 0


# ---------------------------------------------------------------------- tokenizers


def test_patterns_are_those_of_the_library(byte_path, word_path):
    word, byte = pretokens.PreTokenizer(word_path), pretokens.Encoder(byte_path)
    exact = Tokenizer.from_file(byte_path)
    chosen = random.Random(4)
    alphabet = [chr(n) for n in range(256)] + [" "] * 60 + ["\n"] * 20 + list("'stdlm") * 3
    special = ["<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é", "　", "中", "😀", " "]
    texts = ["".join(chosen.choices(alphabet + special * (n % 2), k=chosen.randrange(30))) for n in range(4_000)]
    texts += [f"{a}{chr(n)}{b}" for n in range(256) for a, b in (("", ""), ("a", "b"), (" ", " a"))]
    for text in texts:
        ids = exact.encode(text, add_special_tokens=False).ids
        whole = b"".join(i.to_bytes(4, "little") for i in ids)
        assert byte.ids(text) == whole, repr(text)
        parts = list(pretokens.segments(text, 3))
        assert "".join(parts) == text and b"".join(map(byte.ids, parts)) == whole, repr(text)
        special_tokens, chunks, others = token_counts.frequencies(word, text)
        count = special_tokens + sum(n * word.count(p) for p, n in others.items())
        count += sum(n * word.count(p) for c, n in chunks.items() for p in word.of_chunk(c))
        assert count == len(word.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("frequent", [200_000, 4, 0])
def test_counts_equal_the_library(make_docs, odd_rows, word_path, frequent):
    exact = Tokenizer.from_file(word_path)
    want = Counter()
    for doc_id, text in odd_rows:
        n = len(exact.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    found = token_counts.count_tokens(make_docs(odd_rows), word_path, frequent=frequent)
    assert Counter(map(tuple, found.collect())) == want
    assert token_counts.count_tokens(make_docs([]), word_path).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pretokens.PreTokenizer("vocabulary.model")


# ------------------------------------------------------------------------- packing


def sequences_of(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for used in places.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packed_ids_are_the_documents(make_docs, odd_rows, byte_path):
    rows = odd_rows + [(1_000 + n, "word " * (37 * n)) for n in range(60)]
    found = packing.pack_documents(make_docs(rows), byte_path, parts=3).collect()
    exact = Tokenizer.from_file(byte_path)
    want = Counter()
    for doc_id, text in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        start = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids), 2048)):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            want[(doc_id, piece, start, length, zlib.crc32(raw))] += 1
            start += length
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert got == want
    assert sequences_of(found, 2048) <= -(-sum(r.length for r in found) // 2048) + 1
    assert packing.pack_documents(make_docs([]), byte_path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_every_length_is_placed(seed):
    chosen = random.Random(seed)
    capacity = chosen.choice([10, 100, 512])
    histogram = {n: chosen.randrange(1, 400) for n in chosen.sample(range(1, capacity + 1), capacity // 2)}
    patterns = packing.solve(histogram, capacity, groups=chosen.choice([1, 4, 32]))
    held = Counter()
    for pattern in patterns:
        assert sum(pattern.lengths) <= capacity
        for length in pattern.lengths:
            held[length] += pattern.times
    assert held == histogram
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    halves = sum(v for k, v in histogram.items() if 2 * k > capacity)
    assert sum(p.times for p in patterns) <= 1.12 * max(least, halves) + 2


def test_groups_have_equal_cardinality():
    groups = packing.groups_of({n: 10 for n in range(50, 150)}, small=20, groups=8)
    assert [sum(n for _, n in group) for group in groups] == [125] * 8
    assert [group[0][0] for group in groups] == sorted((g[0][0] for g in groups), reverse=True)


def test_configurations_are_optimal():
    import numpy as np

    # Two of 5 fill a bin of 10; 3 and 7 do; 12 of each need 6 + 12 bins.
    used = packing.configurations(np.array([7, 5, 3]), np.array([12.0, 12.0, 12.0]), 10)
    assert abs(sum(amount for _, amount in used) - 18) < 1e-6


# ------------------------------------------------------------------------- chat


def conversation_digest(rows):
    turns = [(t is not None, t or 0, r or "", x or "") for t, r, x in rows]
    turns.sort()
    text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(text), len(loss), sha(loss)


@pytest.fixture
def conversation_rows(words):
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", f"be brief {c}"))
        for t in range(1, 60 * c + 4):
            role = "assistant" if t % 2 == 0 else "user"
            rows.append((c, t, role, " ".join(words(f"{c}-{t}", 10 + t % 40))))
    control = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| |> <"
    rows += [(50, 0, "user", control), (50, 1, "assistant", control), (51, 0, "assistant", None)]
    rows += [(52, 3, None, "x"), (52, None, "user", "y"), (52, 3, "assistant", "z"), (52, 3, "assistant", "z")]
    rows += [(None, 1, "user\nodd%0A", "q"), (53, 0, "assistant", " ".join(words("huge", 5_000)))]
    return rows


@pytest.mark.parametrize("budget,block", [(2048, 1024), (300, 1024), (120, 32)])
def test_conversations_are_read_back(llm, conversation_rows, byte_path, budget, block):
    rows = [(*r, "x") for r in conversation_rows]
    table = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    windows = chat_windows.format_conversations(table, byte_path, budget, block)
    by_id = defaultdict(list)
    for c, *row in conversation_rows:
        by_id[c].append(row)
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat_windows.window_digests(windows).collect()
    }
    assert got == {c: conversation_digest(turns) for c, turns in by_id.items()}
    for w in windows.collect():
        assert w.over_budget == (w.n_tokens > budget)
        if w.over_budget:
            assert len(chat_windows.TURN.findall(w.text)) == 1
        if w.repeated and w.conv_id in (3, 5):
            assert w.text.startswith("<|im_start|>system\n")


def test_no_conversations(llm, byte_path):
    none = llm.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows.window_digests(chat_windows.format_conversations(none, byte_path)).count() == 0


def test_escaping_is_reversible():
    chosen = random.Random(8)
    for _ in range(3_000):
        text = "".join(chosen.choices(["<", "\\", "|", "x", "\n", "<|im_end|>", "%0A"], k=12))
        assert chat_windows.unescape(chat_windows.escape(text)) == text
        assert "<|" not in chat_windows.escape(text)
        assert chat_windows.unescape_role(chat_windows.escape_role(text)) == text
        assert "\n" not in chat_windows.escape_role(text)


# --------------------------------------------------------------------- licences


def test_alignment_is_increasing_and_long():
    chosen = random.Random(6)
    for _ in range(100):
        template = [b"w%d" % n for n in range(60)]
        text = [w for w in template if chosen.random() > 0.15]
        for _ in range(6):
            text.insert(chosen.randrange(len(text)), b"x%d" % chosen.randrange(3))
        pairs = license_scan.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        blocks = difflib.SequenceMatcher(None, text, template, autojunk=False).get_matching_blocks()
        assert len(pairs) >= sum(b.size for b in blocks)


def test_longest_increasing_subsequence():
    chosen = random.Random(9)
    for _ in range(200):
        values = chosen.sample(range(30), 9)
        best = 0
        for mask in range(1 << 9):
            part = [v for n, v in enumerate(values) if mask >> n & 1]
            best = max(best, len(part) * (part == sorted(part)))
        assert len(license_scan.increasing(list(enumerate(values)))) == best


def test_licences_are_found(make_docs, words, odd_rows):
    noise = " ".join(words("noise", 3_000)) + " the license of the software is the "
    mit = license_scan.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "gratis").replace("sublicense, ", "").upper()
    rows = [
        *odd_rows,
        (20, noise + mit + noise + mit),
        (21, noise + edited),
        (22, noise),
        (23, "x Released under the\nMIT license! y"),
        (24, mit[: len(mit) // 2]),
    ]
    found = license_scan.scan_licenses(make_docs(rows)).collect()
    got = Counter((r.doc_id, r.license) for r in found)
    assert got == {(20, "MIT"): 2, (21, "MIT"): 1, (23, "MIT-line"): 1}
    size = len(license_scan.words_of(mit.encode()))
    for r in found:
        if r.doc_id == 20:
            assert r.coverage == 1 and r.end_word - r.first_word == size == r.n_aligned
    assert license_scan.scan_licenses(make_docs([])).count() == 0


def test_licences_with_long_insertions(make_docs, words):
    apache = "Licensed under the terms and conditions of the Apache License, Version 2.0"
    notice = license_scan.TEMPLATES["Apache-2.0"].split()
    half = len(notice) // 2
    rows = [(1, apache)]
    for doc_id, length in ((2, half), (3, 20 * half)):
        rows.append((doc_id, " ".join([*notice[:half], *words("inserted", length), *notice[half:]])))
    rows.append((4, " ".join([*words("before", 500), *notice, *words("after", 500)])))
    found = license_scan.scan_licenses(make_docs(rows)).collect()
    got = {(r.doc_id, r.license): r for r in found}
    assert len(found) == len(got)
    line = got[1, "Apache-2.0-line"]
    assert line.coverage == 1 and (line.first_word, line.end_word) == (0, 12)
    size = len(license_scan.words_of(" ".join(notice).encode()))
    for doc_id, more in ((2, half), (3, 20 * half), (4, 0)):
        row = got[doc_id, "Apache-2.0"]
        assert row.coverage == 1 and row.end_word - row.first_word == size + more


def test_coverage_does_not_hang_on_windows():
    chosen = random.Random(12)
    template = license_scan.Template("t", " ".join(chosen.choices("abcdefgh", k=15)))
    for _ in range(300):
        text = [w.encode() for w in chosen.choices("abcdefghxyz", k=chosen.randrange(8, 60))]
        best = [0] * 16
        for word in text:
            row = [0]
            for n, own in enumerate(template.words):
                row.append(best[n] + 1 if own == word else max(best[n + 1], row[n]))
            best = row
        found = list(template.scan(text, Counter(text), 60))
        assert bool(found) == (best[-1] >= 9)
        assert all(p[1] <= q[0] for p, q in zip(found, found[1:]))
        assert all(n >= 9 and 0 <= a < b <= len(text) for a, b, n in found)


def test_usual_notices_have_templates(make_docs):
    gnu = (
        "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "{1} General Public License as published by the Free Software Foundation; either version {2} of the "
        "License, or (at your option) any later version. This {0} is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details."
    )
    bsd = (
        "* Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. * Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    )
    use = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: "
    )
    name = (
        " * Neither the name of Example Inc. nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    )
    mpl = (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )
    free = (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )
    zero = (
        "To the extent possible under law, Jo has waived all copyright and related or neighboring rights to "
        "this work."
    )
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    texts = {
        "GPL-2.0": gnu.format("program", "", "2"),
        "LGPL-2.1": gnu.format("library", "Lesser", "2.1"),
        "LGPL-3.0": gnu.format("program", "Lesser", "3"),
        "AGPL-3.0": gnu.format("program", "Affero", "3"),
        "BSD-2-Clause": use + bsd,
        "BSD-3-Clause": use + bsd + name,
        "MPL-2.0": mpl,
        "Unlicense": free,
        "CC0-1.0": zero,
        "CC-BY-4.0": cc.format("Attribution"),
        "CC-BY-SA-4.0": cc.format("Attribution-ShareAlike"),
        "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
        "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    }
    found = license_scan.scan_licenses(make_docs(list(enumerate(texts.values())))).collect()
    for number, name in enumerate(texts):
        rows = [r for r in found if r.doc_id == number]
        # Texts of one family cover each other: the most aligned words, then the coverage.
        assert max(rows, key=lambda r: (r.n_aligned, r.coverage)).license == name
