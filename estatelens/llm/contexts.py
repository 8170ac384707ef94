"""Variable-order byte context trees as flat tables: a bounded model that scores many texts at once with array lookups.

A node is a context, the bytes before a position; its parent forgets the oldest byte.  At every position the walk goes back byte by byte to the
longest context that the tree knows and takes that node's cost for the next byte, so costs for what a context has not seen (escapes, backoff)
are worked out once, when the table is made.
"""

from __future__ import annotations

import numpy as np

#: Positions scored together; bounds a task's memory whatever the texts' lengths.
BLOCK = 1 << 17


class ContextTable:
    """``classes``: class of each byte, 0 for bytes without one; ``jump``: state and class to state; ``cost``: node and class to a cost for each model."""

    def __init__(self, depth: int, classes: np.ndarray, jump: np.ndarray, cost: np.ndarray, inner: int):
        self.depth, self.classes, self.jump, self.cost, self.inner = depth, classes, jump, cost, inner

    @classmethod
    def of(cls, symbols: list[int], contexts: list[np.ndarray], costs: list[np.ndarray]) -> ContextTable:
        """``contexts[k]``: sorted contexts of k bytes, the latest byte lowest, each with its parent in ``contexts[k - 1]``; ``costs[k]``: (context, class, model)."""
        depth, width = len(contexts) - 1, len(symbols) + 1
        classes = np.zeros(256, np.uint8 if width <= 256 else np.uint16)
        classes[symbols] = np.arange(1, width)
        sizes = [len(c) for c in contexts]
        first = np.concatenate([[0], np.cumsum(sizes)])
        inner = int(first[depth]) if depth else int(first[1])
        # States: inner nodes, the same nodes as places where the walk has ended, then the deepest nodes.
        jump = np.repeat((np.arange(2 * inner) % inner) + inner, width).reshape(2 * inner, width).astype(np.int64)
        for k in range(1, depth + 1):
            if not sizes[k]:
                continue
            parent = np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (k - 1)) - 1)) + first[k - 1]
            oldest = classes[(contexts[k] >> (8 * (k - 1))) & 255]
            node = np.arange(sizes[k]) + first[k]
            jump[parent, oldest] = node if k < depth else node + inner
        return cls(depth, classes, (jump * width).astype(np.int32).ravel(), np.concatenate(costs).reshape(-1, costs[0].shape[2]).astype(np.float32), inner * width)

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """(text, model): sums of costs over every byte of each text."""
        sums = np.zeros((len(texts), self.cost.shape[1]))
        # A byte of class 0 before each text ends the walk there; its own cost doesn't count.
        raw = np.frombuffer(b"\0" + b"\0".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
        line = np.zeros(len(raw) + self.depth, np.int32)
        line[self.depth :] = self.classes[raw]
        line[starts + self.depth] = 0
        for a in range(0, len(raw), BLOCK):
            b = min(a + BLOCK, len(raw))
            state = np.zeros(b - a, np.int32)
            for k in range(1, self.depth + 1):
                state = self.jump[state + line[a + self.depth - k : b + self.depth - k]]
            state -= self.inner * (state >= self.inner)
            costs = self.cost[state + line[a + self.depth : b + self.depth]]
            one, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            own = starts[one:last] - a
            costs[own[own >= 0]] = 0
            sums[one:last] += np.add.reduceat(costs, np.maximum(own, 0), axis=0, dtype=np.float64)
        return sums


class GramTable:
    """The same sums from n-grams that were seen: nothing is stored for a context's other bytes but one escape, so the table grows with what was learned.

    ``seen[k]``: sorted n-grams of k + 1 bytes, none of them 0, and ``costs[k]`` (n-gram, model); ``contexts[k]``: sorted contexts of k bytes and
    ``escapes[k]`` (context, model), what a byte not seen in it costs besides its cost one order lower; below the empty context it costs ``base``.
    """

    def __init__(self, seen: list[np.ndarray], costs: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray], base: float = 8.0):
        self.seen, self.costs, self.contexts, self.escapes, self.base = seen, costs, contexts, escapes, base

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for part in (self.seen, self.costs, self.contexts, self.escapes) for a in part)

    def of_grams(self, packed: np.ndarray) -> np.ndarray:
        """(n-gram, model): the cost of the latest byte of each packed n-gram of the longest order."""
        found = np.zeros((len(packed), self.costs[0].shape[1]))
        left = np.arange(len(packed))
        for k in range(len(self.seen) - 1, -1, -1):
            own = packed[left] & ((1 << 8 * (k + 1)) - 1)
            hit, at = _places(self.seen[k], own)
            found[left[hit]] += self.costs[k][at[hit]]
            left, own = left[~hit], own[~hit]
            known, at = _places(self.contexts[k], own >> 8)
            found[left[known]] += self.escapes[k][at[known]]
        found[left] += self.base
        return found

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """(text, model): sums of costs over every byte of each text."""
        depth = len(self.seen) - 1
        sums = np.zeros((len(texts), self.costs[0].shape[1]))
        raw = np.frombuffer(b"\0" + b"\0".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
        for a in range(0, len(raw), BLOCK):
            b = min(a + BLOCK, len(raw))
            line = np.zeros(b - a + depth, np.int64)
            before = min(a, depth)
            line[depth - before :] = raw[a - before : b]
            packed = np.zeros(b - a, np.int64)
            for k in range(depth + 1):
                packed |= line[depth - k : depth - k + b - a] << (8 * k)
            # A text's first bytes have no context: what stands before the separator goes.
            for k in range(1, depth + 1):
                packed &= np.where((packed >> (8 * k)) & 255, -1, (1 << 8 * k) - 1)
            kinds, place = np.unique(packed, return_inverse=True)
            costs = self.of_grams(kinds)[place]
            one, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            own = starts[one:last] - a
            costs[own[own >= 0]] = 0
            sums[one:last] += np.add.reduceat(costs, np.maximum(own, 0), axis=0)
        return sums


def _places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` are in sorted ``keys``, and where."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, at


def whole(packed: np.ndarray, size: int) -> np.ndarray:
    """Whether none of the latest ``size`` bytes is 0."""
    inside = np.ones(len(packed), bool)
    for b in range(size):
        inside &= ((packed >> (8 * b)) & 255) != 0
    return inside


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it (0 before a text's start), packed with the latest lowest, and how often.

    Texts are counted in pieces of some BLOCK bytes, whose counts are added up, so that memory goes with the distinct ones.
    """
    kinds, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[bytes] = []
    size = 0
    for text in (*texts, None):
        if held and (text is None or size + len(text) > 4 * BLOCK):
            new, n = _counted(held, depth)
            kinds, place = np.unique(np.concatenate([kinds, new]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, n])).astype(np.int64)
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)
    return kinds, times


def _counted(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    pad = b"\0" * depth
    raw = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    packed = np.zeros(len(raw) - depth, np.int64)
    for k in range(depth + 1):
        packed |= raw[depth - k : len(raw) - k] << (8 * k)
    sizes = np.array([len(t) for t in texts])
    own = np.ones(len(packed), bool)
    starts = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):
        own[starts + k] = False
    return np.unique(packed[own], return_counts=True)
