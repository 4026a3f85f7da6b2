"""Pre-tokens of byte-level BPE vocabularies, and what they become.

BPE never merges across pre-tokens, so a text's tokens follow from its pre-tokens
alone.  Texts in Latin-1 are cut with fixed patterns; any other text, or one that
holds the string of a special token, goes through the tokenizer's own normalizer and
pre-tokenizer, so Unicode tables are always those of the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from tokenizers import Tokenizer

# Executors run a task per core: no threads of the tokenizer's own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Entries a memo may hold; once full it stays as it is.
MEMO_ENTRIES = 800_000

# The classes \p{L} and \p{N} within Latin-1, lower and upper case.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
DIGITS = "0-9²³¹¼-¾"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

WORD_PATTERN = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
BYTE_PATTERN = re.compile(
    rf"{ENDINGS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"
)

# White space to Python that is not white space to the tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")

# A space in front of other white space: there words do not end before a space.
WIDE_SPACE = re.compile(r" \s")

# The settings the two fixed patterns stand for.
WORD_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {
                "type": "ByteLevel",
                "add_prefix_space": False,
                "trim_offsets": True,
                "use_regex": False,
            },
        ],
    },
}
BYTE_SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {
        "type": "ByteLevel",
        "add_prefix_space": False,
        "trim_offsets": True,
        "use_regex": True,
    },
}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: Latin-1 characters for
    themselves, the others by the next ones from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()
_TO_CHARACTERS = str.maketrans(dict(enumerate(CHARACTERS)))
_TO_BYTES = {character: byte for byte, character in enumerate(CHARACTERS)}


def mapped(pretoken: str) -> str:
    return pretoken.encode().decode("latin-1").translate(_TO_CHARACTERS)


def unmapped(characters: str) -> str:
    return bytes(map(_TO_BYTES.__getitem__, characters)).decode()


def is_plain(text: str) -> bool:
    """Within Latin-1, without separators the patterns would take for white space."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return SEPARATORS.search(text) is None


class PreTokenizer:
    """A byte-level BPE tokenizer taken apart."""

    def __init__(self, path: str) -> None:
        if not path.endswith(".json"):
            raise ValueError(f"not a tokenizers file: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        found = {key: settings[key] for key in BYTE_SETTINGS}
        if settings["truncation"] or settings["padding"] or settings["post_processor"]:
            raise ValueError("tokenizers that truncate, pad or add tokens are not supported")
        self.words = found == WORD_SETTINGS
        self.spaced = found == BYTE_SETTINGS
        if not self.words and not self.spaced:
            raise ValueError("only the two known byte-level settings are supported")
        self.specials = {t["content"]: t["id"] for t in settings["added_tokens"]}
        for added in settings["added_tokens"]:
            if added["normalized"] or added["lstrip"] or added["rstrip"] or added["single_word"]:
                raise ValueError(f"unsupported kind of added token: {added['content']}")
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest)) or r"(?!)")
        self.tokenize = self.tokenizer.model.tokenize

    def split_specials(self, text: str) -> tuple[list[str], list[str]]:
        """The text between special tokens, and these."""
        return self.special.split(text), self.special.findall(text)

    def by_library(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text without special tokens, by the library itself."""
        normalizer = self.tokenizer.normalizer
        if normalizer is not None:
            text = normalizer.normalize_str(text)
        for characters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            yield unmapped(characters)

    def of_chunk(self, chunk: str) -> list[str]:
        """Pre-tokens of plain text without white space, for a word vocabulary."""
        return WORD_PATTERN.findall(chunk.lower())

    def count(self, pretoken: str) -> int:
        return len(self.tokenize(mapped(pretoken)))

    def encode(self, pretoken: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        tokens = self.tokenize(mapped(pretoken))
        return b"".join([token.id.to_bytes(4, "little") for token in tokens])


_TAKEN_APART: dict[str, PreTokenizer] = {}


def pretokenizer(path: str) -> PreTokenizer:
    """One for a worker process: loading a vocabulary takes longer than a small task."""
    if path not in _TAKEN_APART:
        _TAKEN_APART[path] = PreTokenizer(path)
    return _TAKEN_APART[path]


# Characters of a long text that are taken at once.
SEGMENT = 1 << 18

# A space between two characters that are none: both patterns begin a pre-token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text in parts whose pre-tokens are those of the whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of texts for a vocabulary whose pre-tokens carry their leading space.

    Plain text is cut before every space that a word follows; the pieces are
    looked up in a memo of bounded size.
    """

    def __init__(self, path: str) -> None:
        self.pre = PreTokenizer(path)
        if not self.pre.spaced:
            raise ValueError("this vocabulary is not spaced")
        self.after_space = _Memo(self._spaced)
        self.inner = _Memo(self.pre.encode)

    def _spaced(self, chunk: str) -> bytes:
        first, *rest = BYTE_PATTERN.findall(" " + chunk)
        if not rest:
            return self.pre.encode(first)
        known = self.after_space[first[1:]] if len(first) > 1 else self.inner[first]
        return known + b"".join(map(self.inner.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._segment_ids, segments(text)))

    def _segment_ids(self, text: str) -> bytes:
        if not is_plain(text) or self.pre.special.search(text):
            return self._by_library(text)
        if WIDE_SPACE.search(text) or text.endswith(" "):
            return b"".join(map(self.inner.__getitem__, BYTE_PATTERN.findall(text)))
        chunks = text.split(" ")
        head = b"".join(map(self.inner.__getitem__, BYTE_PATTERN.findall(chunks[0])))
        return head + b"".join(map(self.after_space.__getitem__, chunks[1:]))

    def _by_library(self, text: str) -> bytes:
        parts, specials = self.pre.split_specials(text)
        out = []
        for number, part in enumerate(parts):
            out.extend(map(self.inner.__getitem__, self.pre.by_library(part)))
            if number < len(specials):
                out.append(self.pre.specials[specials[number]].to_bytes(4, "little"))
        return b"".join(out)


class _Memo(dict):
    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < MEMO_ENTRIES:
            self[key] = value
        return value


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process: its memo serves all tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
