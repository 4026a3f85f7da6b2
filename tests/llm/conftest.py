from __future__ import annotations

import os
import random

import public_tokenizers
import pytest

from wayside.llm.common import prepared

SF_DIR = "/root/testdata/sf0.001"

# Names that operators use inside or return: extra input columns must not disturb.
CLASHING = ["kept", "score", "digest", "seed", "number", "value", "component_id", "row_key", "node"]


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture
def make_docs(llm):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows, parts=3):
        schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
        full = [(*row, *("x" for _ in CLASHING)) for row in rows]
        return llm.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def byte_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def words():
    """A generator of made-up words."""
    return lambda seed, n: [
        "".join(random.Random(f"{seed}-{i}").choices("abcdefgh", k=4)) for i in range(n)
    ]


@pytest.fixture
def odd_rows(words):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(words("long", 30_000))
    return [
        (1, "One two three."),
        (1, "One two three."),
        (2, "One two three."),
        (3, None),
        (4, ""),
        (None, "One two three."),
        (None, None),
        (5, long),
        (6, long),
        (7, " \n\t "),
        (8, "Größe 中文 😀 <|endoftext|> it's"),
        (9, "solo"),
    ]


def has_tables() -> bool:
    return os.path.isdir(SF_DIR)
