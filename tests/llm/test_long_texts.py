"""What one text of 50 MB takes: blocks of it are held, not all its words."""

from __future__ import annotations

import subprocess
import sys

import pytest

# A text of some 8 million words, the function, and how far the peak rises above the
# text's own copies.
CODE = """
import random, resource, types
import numpy as np, pyarrow as pa
import public_tokenizers
from wayside.llm import {module}
words = ["".join(random.Random(n).choices("abcdefgh", k=5)) for n in range(5_000)]
part = " ".join(random.Random(1).choices(words, k=400_000)) + " "
text = (part * 21)[: 50 << 20]
FREQUENT = types.SimpleNamespace(value=(np.arange(9), np.ones(9), [b"a", b"b"], np.ones(2, int)))
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
body = {body}
{module}.{warm}
before = peak()
{module}.{call}
print(peak() - before)
"""


@pytest.mark.parametrize(
    "module, body, warm, call, most",
    [
        ("simhash_balls", "text.encode()", "fingerprint(b'a b c')", "fingerprint(body)", 150),
        ("minhash_join", "text.encode()", "shingle_set(b'a b c')", "shingle_set(body)", 250),
        (
            "target_resampling",
            "text.encode()",
            "shifted(__import__('numpy').zeros(1, 'u4'), __import__('numpy').ones(1, int))",
            "__dict__['feature_blocks'] and [None for _ in target_resampling.feature_blocks([body], 3, 10_000)]",
            150,
        ),
        (
            "lm_scoring",
            "pa.RecordBatch.from_arrays([pa.array([text.encode()]), pa.array([True])], ['content', 'learn'])",
            "count_keys and sum(1 for _ in lm_scoring._count_task(iter([])))",
            "count_keys and sum(b.num_rows for b in lm_scoring._count_task(iter([body])))",
            300,
        ),
        (
            "lm_scoring",
            "pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([True]), pa.array([text.encode()])], list('abcd'))",
            "Lookup(np.arange(9), np.ones(9))",
            "count_keys and sum(b.num_rows for b in lm_scoring._score_task(FREQUENT, 9, 9)(iter([body])))",
            250,
        ),
        (
            "pretokens",
            "text",
            "encoder(public_tokenizers.path('byte_bpe_50k.json')).ids('a b')",
            "encoder(public_tokenizers.path('byte_bpe_50k.json')).ids(body)",
            200,
        ),
    ],
)
def test_peak_of_a_long_text(module, body, warm, call, most):
    code = CODE.format(module=module, body=body, warm=warm, call=call)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2_000:]
    assert int(done.stdout) < most
