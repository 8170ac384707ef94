"""Runs of words that repeat with a period, found by block convolution, and texts with each run collapsed to one period.

A run is a stretch of consecutive words with smallest period q and at least ``max(6, 4 q)`` words that no neighbouring word extends.  Words are numbered
exactly; a task joins the texts of a slice into one sequence with a mark of its own between any two.  For each power of two B, periods from B to 2 B - 1
are sought: a run of that period holds an aligned block of B words and its repetition one period on.  The sum of squared differences between a block
and every stretch of the window that follows it comes from one cyclic convolution by number theoretic transforms, under so many primes that a sum that is
zero under all of them is zero.  The distance of each exact occurrence is a seed; seeds of one distance in adjoining blocks are one stretch, and fewer than B
words remain to be compared on each side of it.

What keeps that linear, up to logarithms, on any text: blocks with a word that doesn't come again within 2 B words aren't transformed; seeds inside a run
with a smaller period belong to that run and go; stretches with too few blocks for four periods go before they are extended.  None of these
drops a run.

Defined results: null texts, empty texts and texts of white space have no words and no runs, and collapse to an empty text; rows are worked on alone, so
repeated rows and ids give equal rows; ties between runs go to the smaller start, then to the smaller period; an empty table gives an empty one; other
columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import as_bytes, slices

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Primes with roots of unity of order 2**26 (enough for texts of 134 million words), and a generator of each group: fixed values.
PRIMES = ((2013265921, 31), (469762049, 3), (1811939329, 13))
#: Numbers transformed or compared at once.
CELLS = 1 << 18
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _twiddles(prime: int, root: int, half: int) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 half``."""
    step, powers = pow(root, (prime - 1) // (2 * half), prime), np.ones(1, np.int64)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * pow(step, len(powers), prime) % prime])
    return powers


def forward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The transform of each row, a power of two long, in bit-reversed order."""
    half = rows.shape[1] // 2
    while half:
        pairs = rows.reshape(len(rows), -1, 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([(left + right) % prime, (left - right + prime) * _twiddles(prime, root, half) % prime], axis=2).reshape(rows.shape)
        half //= 2
    return rows


def backward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The inverse of :func:`forward`."""
    half, size = 1, rows.shape[1]
    while half < size:
        pairs = rows.reshape(len(rows), -1, 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1] * _twiddles(prime, pow(root, -1, prime), half) % prime
        rows = np.stack([(left + right) % prime, (left - right + prime) % prime], axis=2).reshape(rows.shape)
        half *= 2
    return rows * pow(size, -1, prime) % prime


def mismatch(blocks: np.ndarray, windows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Row by row, the sum of squared differences modulo ``prime`` between a block of B numbers and each of the B stretches of a window of 2 B - 1."""
    size = blocks.shape[1]
    turned, long = np.zeros((2, len(blocks), 2 * size), np.int64)
    turned[:, :size], long[:, : 2 * size - 1] = blocks[:, ::-1] % prime, windows % prime
    # Cyclic sums wrap into the first places only; the stretches lie behind them.
    cross = backward(forward(turned, prime, root) * forward(long, prime, root) % prime, prime, root)[:, size - 1 : 2 * size - 1]
    squares = np.cumsum(np.pad(long * long % prime, ((0, 0), (1, 0))), axis=1)
    own = (turned * turned % prime).sum(axis=1, keepdims=True)
    return (own + squares[:, size : 2 * size] - squares[:, :size] - 2 * cross) % prime


def _seeds(codes: np.ndarray, blocks: np.ndarray, size: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) of every exact occurrence of a block ``size`` to ``2 size - 1`` words after itself."""
    found, step, last = [], max(1, CELLS // (2 * size)), len(codes) - 1
    for first in range(0, len(blocks), step):
        rows = blocks[first : first + step]
        starts, bound, product = rows * size, size * distinct * distinct, 1
        at, seen = np.arange(len(rows)), None
        for prime, root in PRIMES:
            block = codes[starts[at, None] + np.arange(size)]
            window = codes[np.minimum(starts[at, None] + np.arange(size, 3 * size - 1), last)]
            zero = mismatch(block, window, prime, root) == 0
            seen = zero if seen is None else seen[kept] & zero
            kept = seen.any(axis=1)
            at, product = at[kept], product * prime
            if product > bound or not len(at):
                break
        row, distance = np.nonzero(seen[kept])
        found.append((rows[at][row], distance + size))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agree(codes: np.ndarray, start: np.ndarray, distance: np.ndarray, size: int, step: int) -> np.ndarray:
    """How many of the ``size`` words from ``start`` on, in the direction ``step``, equal those ``distance`` later without a break."""
    out, rows, last = np.zeros(len(start), np.int64), max(1, CELLS // size), len(codes) - 1
    for first in range(0, len(start), rows):
        near = start[first : first + rows, None] + step * np.arange(size)
        equal = codes[np.clip(near, 0, last)] == codes[np.clip(near + distance[first : first + rows, None], 0, last)]
        out[first : first + rows] = np.where(equal.all(axis=1), size, equal.argmin(axis=1))
    return out


def find_runs(codes: np.ndarray, lengths: np.ndarray, distinct: int) -> np.ndarray:
    """Rows (start, length, period) by start and period.  ``codes`` are numbers below ``distinct``, with a number found once only at both ends and between texts;
    ``lengths`` gives for each place the number of words of its text."""
    order = np.argsort(codes, kind="stable")
    gap = np.full(len(codes), len(codes), np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    reach, out, size, longest = np.zeros(len(codes), np.int64), [], 1, int(lengths.max(initial=0))
    while LEAST_PERIODS * size <= longest:
        blocks = np.flatnonzero(gap < 2 * size)
        blocks = blocks[lengths[blocks * size] >= LEAST_PERIODS * size]
        if len(blocks):
            block, distance = _seeds(codes, blocks, size, distinct)
            new = block * size + size + distance > reach[block * size]
            block, distance = block[new], distance[new]
            order = np.lexsort((block, distance))
            block, distance = block[order], distance[order]
            head = np.flatnonzero(np.diff(block, prepend=-2) + len(codes) * np.diff(distance, prepend=0) != 1)
            tail = np.append(head[1:], len(block)) - 1
            if len(head):
                enough = tail - head + 1 >= np.maximum(1, ((LEAST_PERIODS - 1) * distance[head] - size + 1) // size)
                start, end, period = block[head][enough] * size, (block[tail][enough] + 1) * size, distance[head][enough]
                start = start - _agree(codes, start - 1, period, size, -1)
                end = end + _agree(codes, end, period, size, 1) + period
                long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
                out.append(np.stack([start, end - start, period], axis=1)[long])
                np.maximum.at(reach, start[long], end[long])
                reach = np.maximum.accumulate(reach)
        size *= 2
        gap = np.pad(gap, (0, len(gap) % 2), constant_values=len(codes))
        gap = np.maximum(gap[0::2], gap[1::2])
    runs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words, counts = words_of(part.column("text"))
        coded = words.dictionary_encode()
        known, total = len(coded.dictionary), int(counts.sum())
        # Text k starts after k + 1 marks.
        starts = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(total) + owner + 1
        codes = np.empty(total + len(counts) + 1, np.int64)
        codes[starts + np.arange(len(counts) + 1)] = known + np.arange(len(counts) + 1)
        codes[place] = coded.indices.to_numpy()
        lengths = np.zeros(len(codes), np.int64)
        lengths[place] = counts[owner]
        runs = find_runs(codes, lengths, known + len(counts) + 1)
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(edges)[place] == 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(counts)))])
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), " ")
        of = np.searchsorted(starts + np.arange(len(counts) + 1), runs[:, 0], side="right") - 1
        runs[:, 0] -= starts[of] + of + 1
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(counts)))])
        found = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found), texts.cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words outside every run and each run's first period."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_collapse, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place after the contract's change: in texts whose id's hash ends in 0 the tail repeats a period."""
    at = np.arange(n)
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return at
    g = h // 10
    a = g % n
    return np.where(at >= a, a + (at - a) % (1 + (n - a) // (3 + g % 8)), at)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        ids, texts = part.column("doc_id").to_pylist(), as_bytes(part.column("text"))
        for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
                words = text.split()
                texts[k] = b" ".join([words[i] for i in planted(doc_id, len(words))])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def plant(docs: DataFrame) -> DataFrame:
    """``documents`` with repeated tails in a tenth of the texts, so that there are runs of every period to find."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_plant, f"doc_id {kind}, text string")


def _stronger(a: Column, b: Column) -> Column:
    """Order of runs by exact exponent, falling, then by start and period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    less = (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    same = (x == y) & (a["start"] == b["start"]) & (a["period"] == b["period"])
    return F.when(same, 0).when(less, -1).otherwise(1)


def digests(found: DataFrame) -> DataFrame:
    """Of :func:`collapse`'s rows: number of runs, the strongest one, and SHA-256 of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = found.select("doc_id", "runs", "collapsed", F.get(F.array_sort("runs", _stronger), F.lit(0)).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
