"""Context-tree weighting over byte contexts, with binary decomposition.

A byte is eight binary decisions, each with a tree of its own: the context of a
decision is the bytes before, latest first, and the bits of the byte so far.  Every
node holds how often the decision was 0 and 1.  A node's Krichevsky-Trofimov estimate
and what its children say are weighed by how well each has coded the counts:

    P(node) = 1/2 KT(node) + 1/2 product of P(children),   P(leaf) = KT(leaf)

so a prediction mixes the estimates of all depths.  Where a context does not occur at
some depth, the mixture ends at the depth before.

The functions work on sorted arrays of gram keys: six bytes, the context with the
latest byte first and the byte that follows last.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5

# Never a byte of UTF-8: it ends every text.
END = 0xFF

# Depth from which on nodes lie in one group of keys.  There are at most 256 ** 2 * 255
# nodes at the depth before; text has some thousands of byte pairs.
GROUP_DEPTH = 3

NATS = np.log(10.0)


def gram_keys(text: bytes, before: bytes = b"", last: bool = True) -> np.ndarray:
    """The key of every byte, and of the end if the text ends here.

    ``before`` is what stands before ``text``; contexts start with zero bytes.
    """
    before = before[-DEPTH:]
    padded = bytes(8 - len(before)) + before + text + bytes([END] * last)
    count = len(text) + last
    # Eight bytes up to each position, read as one number: the latest is the highest.
    latest = np.ndarray(count, "<u8", padded, strides=(1,))
    keys = latest >> np.uint64(8 * (8 - DEPTH))
    keys <<= np.uint64(8)
    keys |= np.frombuffer(padded, np.uint8)[8 : 8 + count]
    return keys.view(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(7):
        low = x < 7
        shift[low] -= np.log(x[low])
        x = np.where(low, x + 1, x)
    inverse = 1 / x
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


# Log gamma at n + 1/2 and n + 1 for small counts n, of which nearly all nodes are.
SMALL = 1 << 12
LOG_HALVES = log_gamma(np.arange(SMALL) + 0.5)
LOG_WHOLES = log_gamma(np.arange(SMALL) + 1.0)


def _of_counts(table: np.ndarray, counts: np.ndarray, shift: float) -> np.ndarray:
    large = np.flatnonzero(counts >= SMALL)
    values = table[np.minimum(counts, SMALL - 1).astype(np.int64)]
    values[large] = log_gamma(counts[large] + shift)
    return values


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of any sequence with these counts, whole numbers."""
    start = np.log(np.pi)  # twice log gamma(1/2)
    halves = _of_counts(LOG_HALVES, zeros, 0.5) + _of_counts(LOG_HALVES, ones, 0.5)
    return halves - _of_counts(LOG_WHOLES, zeros + ones, 1.0) - start


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


def decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth from keys (context, byte): (node, zeros, ones).

    A node is the context with the bits so far, a leading 1 before them.
    """
    nodes, zeros, ones = [], [], []
    context, byte = keys >> 8, keys & 0xFF
    for bit in range(8):
        prefix = (1 << bit) | (byte >> (8 - bit))
        one = (byte >> (7 - bit)) & 1
        node, one_sum, all_sum = summed((context << 8) | prefix, counts * one, counts)
        nodes.append(node)
        ones.append(one_sum)
        zeros.append(all_sum - one_sum)
    return summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))


class Level:
    """The nodes of one depth: counts, log KT, and the weighted log probability."""

    def __init__(self, nodes, zeros, ones, children: np.ndarray | None) -> None:
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        total = zeros + ones
        self.one = (ones + 0.5) / (total + 1.0)
        if children is None:
            self.weight, self.log_p = np.ones(len(nodes)), own
        else:
            # The share of the node's own estimate in its mixture.
            self.weight = 1 / (1 + np.exp(np.clip(children - own, -500, 500)))
            self.log_p = np.logaddexp(own, children) - np.log(2.0)


def parents(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """(parent node, sum of the children's log probabilities)."""
    prefix, context = level.nodes & 0xFF, level.nodes >> 8
    return summed(((context >> 8) << 8) | prefix, level.log_p)


def build_levels(keys: np.ndarray, counts: np.ndarray, shallow: int) -> dict[int, Level]:
    """The levels from ``DEPTH`` up to ``shallow`` of keys with positive counts."""
    levels: dict[int, Level] = {}
    children = None
    for depth in range(DEPTH, shallow - 1, -1):
        # Drop the context bytes beyond this depth, keep the byte that follows.
        short = ((keys >> (8 * (DEPTH + 1 - depth))) << 8) | (keys & 0xFF)
        pairs, sums = summed(short, counts)
        nodes, zeros, ones = decisions(pairs, sums)
        levels[depth] = Level(nodes, zeros, ones, children)
        _, children = parents(levels[depth])
    return levels


def top_levels(nodes, zeros, ones, children) -> dict[int, Level]:
    """The depths before ``GROUP_DEPTH`` from the sums over its nodes."""
    order = np.argsort(nodes)
    levels = {}
    nodes, zeros, ones, children = (c[order] for c in (nodes, zeros, ones, children))
    for depth in range(GROUP_DEPTH - 1, -1, -1):
        levels[depth] = Level(nodes, zeros, ones, children)
        nodes, children = parents(levels[depth])
        shorter = ((levels[depth].nodes >> 16) << 8) | (levels[depth].nodes & 0xFF)
        _, zeros, ones = summed(shorter, zeros, ones)
    return levels


def predict(levels: dict[int, Level], keys: np.ndarray) -> np.ndarray:
    """Log10 probability of each key's byte in its context."""
    total = np.zeros(len(keys))
    byte = keys & 0xFF
    for bit in range(8):
        prefix = (1 << bit) | (byte >> (8 - bit))
        chance = np.full(len(keys), 0.5)
        seen = np.zeros(len(keys), bool)
        for depth in range(DEPTH, -1, -1):
            level = levels[depth]
            if not len(level.nodes):
                continue
            node = ((keys >> (8 * (DEPTH + 1 - depth))) << 8) | prefix
            at = np.minimum(np.searchsorted(level.nodes, node), len(level.nodes) - 1)
            there = level.nodes[at] == node
            own, weight = level.one[at], level.weight[at]
            mixed = np.where(seen, weight * own + (1 - weight) * chance, own)
            chance = np.where(there, mixed, chance)
            seen |= there
        total += np.log(np.where((byte >> (7 - bit)) & 1, chance, 1 - chance))
    return total / NATS
