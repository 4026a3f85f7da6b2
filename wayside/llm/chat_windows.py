"""Chat formatting in windows of a token budget.

A conversation becomes windows of whole turns.  Prefix sums of the turns' tokens say
how far a window reaches.  Every window after the first begins with the conversation's
system turn and a limited history of turns that earlier windows hold already; these
repeated turns are outside the loss mask, so every assistant text is learned once.

Turns are dealt out by conversation and block of ``BLOCK`` turn numbers, so a long
conversation is many groups: a block starts a new window, and gets the turns before it
as history and the system turn by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import map_batches
from wayside.llm.pretokens import encoder

BUDGET = 2048

# What of a window may be repeated history: so many turns, and so many tokens.
HISTORY_TURNS = 8
HISTORY_TOKENS = 512

# Turn numbers in a block.
BLOCK = 1024

START, STOP = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
LEARNED_ROLE = "assistant"
SYSTEM_ROLE = "system"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash more between < and |, so no control string is left."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at the line's end, so they hold no line break either."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


class Turn:
    def __init__(self, number: int | None, role: str, text: str, count) -> None:
        self.number, self.role = number, role
        self.formatted, self.begin, self.end = format_turn(role, text)
        self.tokens = count(self.formatted)


def spans(turns: list[Turn], first: int, system: Turn | None, budget: int) -> Iterator[tuple]:
    """(system or None, first of the history, first new turn, end) of every window.

    ``turns[:first]`` are in earlier windows already.  A turn that does not fit even
    alone is a window of its own, without what may be left out.
    """
    ends = np.concatenate(([0], np.cumsum([turn.tokens for turn in turns])))
    at = first
    while at < len(turns):
        lead = system if system is not None and _before(system, turns[at]) else None
        fixed = lead.tokens if lead else 0
        low = max(0, at - HISTORY_TURNS)
        room = min(HISTORY_TOKENS, budget - fixed - turns[at].tokens)
        # The earliest turn from which on the history fits.
        low = max(low, int(np.searchsorted(ends, ends[at] - max(room, 0))))
        if fixed + turns[at].tokens > budget:
            lead, fixed, low = None, 0, at
        if lead is not None:
            low = max([low, *(n + 1 for n in range(low, at) if turns[n].number == lead.number)])
        left = budget - fixed - (ends[at] - ends[low])
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + left, side="right")) - 1)
        yield lead, low, at, end
        at = end


def _before(system: Turn, turn: Turn) -> bool:
    return turn.number is not None and (system.number is None or system.number < turn.number)


WINDOWS = (
    "conv_id long, block long, window int, first_turn long, last_turn long, repeated int, "
    "text string, loss array<int>, n_tokens long, over_budget boolean"
)
_WINDOW_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("block", pa.int64()),
        ("window", pa.int32()),
        ("first_turn", pa.int64()),
        ("last_turn", pa.int64()),
        ("repeated", pa.int32()),
        ("text", pa.string()),
        ("loss", pa.list_(pa.int32())),
        ("n_tokens", pa.int64()),
        ("over_budget", pa.bool_()),
    ]
)


def windows_of(
    conv_id: int | None, block: int, turns: list[Turn], first: int, system: Turn | None, budget: int
) -> Iterator[dict]:
    for window, (lead, low, at, end) in enumerate(spans(turns, first, system, budget)):
        shown = [lead] * bool(lead) + turns[low:end]
        repeated = len(shown) - (end - at)
        loss, size = [], 0
        for place, turn in enumerate(shown):
            if place >= repeated and turn.role == LEARNED_ROLE:
                loss += [size + turn.begin, size + turn.end]
            size += len(turn.formatted)
        tokens = sum(turn.tokens for turn in shown)
        yield {
            "conv_id": conv_id,
            "block": block,
            "window": window,
            "first_turn": turns[at].number,
            "last_turn": turns[end - 1].number,
            "repeated": repeated,
            "text": "".join(turn.formatted for turn in shown),
            "loss": loss,
            "n_tokens": tokens,
            "over_budget": tokens > budget,
        }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, text: str | None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) if text else 64
        if size > 4 << 20 or len(held) >= 5_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _window_task(path: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        count = lambda text: len(encode(text)) // 4

        def windows() -> Iterator[dict]:
            for (conv_id, block), rows in groupby(_rows(batches), lambda r: (r["conv_id"], r["block"])):
                turns, first, system = [], 0, None
                for row in rows:
                    turns.append(Turn(row["turn"], row["role"], row["text"], count))
                    first += row["history"]
                    if system is None and row["system_text"] is not None:
                        system = Turn(row["system_turn"], SYSTEM_ROLE, row["system_text"], count)
                yield from windows_of(conv_id, block, turns, first, system, budget)

        yield from _batched(windows(), _WINDOW_ARROW, "text")

    return run


def format_conversations(
    conversations: DataFrame, path: str, budget: int = BUDGET, block: int = BLOCK
) -> DataFrame:
    """Windows of the conversations: see ``WINDOWS`` for the columns.

    ``repeated`` turns at the start of ``text`` are in earlier windows; ``loss`` holds
    start and end, in characters, of every text to learn.  Turns are in order of their
    number, null first, then of role and text.  Null texts and roles are empty; null
    ids are one conversation; rows that repeat a turn are turns of their own.  A turn
    longer than the budget makes a window that says so.  An empty table gives no
    windows; other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    systems = (
        turns.filter(F.col("role") == SYSTEM_ROLE)
        .groupBy("conv_id")
        .agg(F.min(F.struct("turn", "text")).alias("system"))
        .select(
            F.col("conv_id").alias("system_id"),
            F.col("system.turn").alias("system_turn"),
            F.col("system.text").alias("system_text"),
        )
    )
    own = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))).cast("long")
    place = F.struct(own.alias("block"), F.lit(0).alias("history"))
    after = F.struct((own + 1).alias("block"), F.lit(1).alias("history"))
    last = F.pmod(F.col("turn"), F.lit(block)) >= block - HISTORY_TURNS
    placed = turns.withColumn(
        "place", F.explode(F.when(last, F.array(place, after)).otherwise(F.array(place)))
    ).select("conv_id", "place.block", "place.history", "turn", "role", "text")
    joined = placed.join(systems, F.col("conv_id").eqNullSafe(F.col("system_id")), "left")
    ordered = (
        joined.drop("system_id")
        .repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", F.desc("history"), "turn", "role", "text")
    )
    return map_batches(ordered, _window_task(path, budget), WINDOWS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
_DIGEST_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[dict]:
        for conv_id, windows in groupby(_rows(batches), lambda r: r["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = formatted = 0
            for window in windows:
                text = window["text"]
                formatted += len(text)
                for role, body in TURN.findall(text)[window["repeated"] :]:
                    n_turns += 1
                    turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                edges = window["loss"]
                for start, end in zip(edges[::2], edges[1::2]):
                    learned = unescape(text[start:end])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
            yield {
                "conv_id": conv_id,
                "n_turns": n_turns,
                "turns_sha256": turns.hexdigest(),
                "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(),
                "formatted_chars": formatted,
            }

    yield from _batched(digests(), _DIGEST_ARROW, None)


def window_digests(windows: DataFrame) -> DataFrame:
    """What the windows say when read back, one row per conversation.

    A digest of a whole conversation follows its windows in order, so they are read as
    a stream in one task, one window at a time.
    """
    ordered = (
        windows.select("conv_id", "block", "window", "repeated", "text", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block", "window")
    )
    return map_batches(ordered, _digest_task, DIGESTS)
