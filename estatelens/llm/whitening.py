"""Whitening of embeddings by an exact integer covariance, from bit-sliced cross-products.

Each entry c becomes ``x = floor(1024 c) + 100000``.  A task takes rows in blocks, subtracts each dimension's smallest x of the block, and packs every bit plane of
every dimension across the rows into words.  The population count of two planes' AND, weighted by both places, adds up to the exact sum of products; the
subtracted minima are put back with the sums.  Tasks send ``d (d + 1) / 2`` exact sums and no rows, the driver centres them as integers
(``n XX' - S S'``) and only then divides and takes eigenvectors.  What reaches the driver depends on the number of dimensions alone.

Defined results: rows whose vector is null, empty or holds null, NaN, infinite entries or entries beyond 2**52 take no part, nor do vectors of another length
than the commonest one (ties: the longer); repeated rows and ids each count and each give their rows; components whose
eigenvalue is zero to double precision have no direction to scale, so ``whitened`` is null there and they don't count in ``identity_error``; equal eigenvalues come in
the order that ``eigh`` gives; an empty table gives an empty one; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Rows whose bit planes are held at once: whole words of 64.
BLOCK = 4096
LARGEST = 2.0**52
#: Eigenvalues below this share of the largest count as zero.
ZERO = 1e-13


def scaled(vectors: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By length: row numbers and the matrix x of the vectors that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        bad = np.cumsum(np.concatenate([[0], ~(np.abs(values * SCALE) < LARGEST)]))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    fit = (sizes > 0) & (bad[ends] == bad[starts])
    out = {}
    for size in np.unique(sizes[fit]):
        rows = np.flatnonzero(fit & (sizes == size))
        out[int(size)] = rows, np.floor(values[starts[rows, None] + np.arange(size)] * SCALE).astype(np.int64) + OFFSET
    return out


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the columns of ``x`` and of the products of each two, as Python integers."""
    n, d = x.shape
    least = x.min(axis=0)
    y = (x - least).astype(np.uint64)
    width = max(1, int(y.max()).bit_length())
    bits = (y[:, :, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    rows = np.zeros((d * width, -(-n // 64) * 64), np.uint8)
    rows[:, :n] = bits.reshape(n, d * width).T
    planes = np.packbits(rows, axis=1).view(np.uint64)
    counts = np.zeros((d * width, d * width), np.int64)
    for k in range(d * width):  # from the own dimension on: the rest is symmetric
        after = k - k % width
        counts[k, after:] = np.bitwise_count(planes[after:] & planes[k]).sum(axis=1)
    small = 2 * width + int(n).bit_length() + 1 < 63
    weights = np.array([1 << k for k in range(width)], dtype=np.int64 if small else object)
    folded = counts.reshape(d * width, d, width).astype(weights.dtype).dot(weights)
    products = weights.dot(folded.reshape(d, width, d).transpose(1, 0, 2).reshape(width, d * d)).reshape(d, d).astype(object)
    upper = np.triu(products)
    products = upper + np.triu(products, 1).T
    sums, base = (y if small else y.astype(object)).sum(axis=0).astype(object), least.astype(object)
    return sums + n * base, products + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums: (size, i, j, value) with j = -1 for the sum of dimension i and i = j = -1 for the number of rows."""
    totals: dict[int, list] = {}
    for batch in batches:
        for size, (_, x) in scaled(batch.column(0)).items():
            for first in range(0, len(x), BLOCK):
                block = x[first : first + BLOCK]
                sums, products = cross_products(block)
                held = totals.setdefault(size, [0, 0, 0])
                totals[size] = [held[0] + len(block), held[1] + sums, held[2] + products]
    for size, (n, sums, products) in totals.items():
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({
            "size": pa.array([size] * (1 + size + len(i)), pa.int32()),
            "i": pa.array([-1, *range(size), *i.tolist()], pa.int32()), "j": pa.array([-1] * (1 + size) + j.tolist(), pa.int32()),
            "value": pa.array([n, *sums, *products[i, j]], pa.decimal128(38, 0)),
        })


@dataclass(frozen=True)
class Fit:
    """Exact sums over the fit list and the leading components of its covariance."""

    n: int
    sums: tuple[int, ...]
    #: Components as columns, by falling eigenvalue.
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Fit | None:
    """The covariance of all vectors, exactly; None where no vector takes part."""
    parts = rows.select(vector).mapInArrow(_scatter, "size int, i int, j int, value decimal(38,0)")
    found = parts.groupBy("size", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
    counts = found.where("i = -1").orderBy(F.desc("value"), F.desc("size")).limit(1)
    table = found.join(F.broadcast(counts.select("size")), "size").toArrow().to_pydict()
    if not table["size"]:
        return None
    size = table["size"][0]
    products, sums, n = np.zeros((size, size), object), [0] * size, 0
    for i, j, value in zip(table["i"], table["j"], map(int, table["value"]), strict=True):
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i, j] = products[j, i] = value
    centred = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    keep = np.arange(size)[::-1][:components]
    return Fit(n, tuple(sums), vectors[:, keep], values[keep], sum(centred[k, k] for k in range(size)) / (n * n))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """For each row the exact sum of ``(n x - S)**2``."""
    reach = int(np.abs(x).max(initial=0)) * n + max(abs(int(s)) for s in sums)
    if reach * reach * x.shape[1] < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    away = n * x.astype(object) - sums
    return (away * away).sum(axis=1).tolist()


def _real(fitted: Fit) -> np.ndarray:
    """Which components have a direction to scale."""
    return fitted.values > ZERO * max(float(fitted.values[0]), 0.0)


def project(x: np.ndarray, fitted: Fit) -> np.ndarray:
    """Whitened coordinates of the rows of ``x``; ``n x - S`` is exact and divided last."""
    n, sums, real = fitted.n, np.array(fitted.sums, object), _real(fitted)
    far = n * int(np.abs(x).max()) + max(map(abs, fitted.sums)) >= 1 << 62
    away = (x.astype(object) * n - sums if far else x * n - sums.astype(np.int64)) / n
    return away.astype(np.float64) @ fitted.vectors / np.sqrt(np.where(real, fitted.values, 1.0))


def whiten(rows: DataFrame, fitted: Fit, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``component`` (from 1), ``deviation`` and ``whitened`` for every vector that takes part."""
    size, kept, real = len(fitted.sums), len(fitted.values), _real(fitted)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, x = scaled(batch.column(1)).get(size, (None, None))
            if place is None:
                continue
            away = pa.array(deviations(x, fitted.n, np.array(fitted.sums, object)), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(place, kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                away.take(pa.array(np.repeat(np.arange(len(x)), kept))), pa.array(project(x, fitted).ravel(), mask=~np.tile(real, len(x))),
            ], [key, "component", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(spread, f"`{key}` {kind}, component int, deviation decimal(38,0), whitened double")


def identity_error(rows: DataFrame, fitted: Fit, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    size, kept, real = len(fitted.sums), len(fitted.values), _real(fitted)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept + 1))
        for batch in batches:
            place, x = scaled(batch.column(0)).get(size, (None, None))
            if place is not None:
                one = np.concatenate([np.ones((len(x), 1)), project(x, fitted)], axis=1)
                total += one.T @ one
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "value"])

    sums = np.zeros((kept + 1, kept + 1))
    parts = rows.select(vector).mapInArrow(moments, "i long, j long, value double")
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        sums[i, j] = value
    mean = sums[0, 1:] / sums[0, 0]
    covariance = sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)
    return float(np.abs((covariance - np.eye(kept))[np.ix_(real, real)]).max(initial=0.0))


OUTPUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Fit on all rows, then for each row and component: ``n``, ``deviation``, ``whitened``, ``explained`` and the fit's ``identity_error``."""
    fitted = fit(rows, vector, components)
    if fitted is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {OUTPUT}")
    shares = [float(v) / fitted.trace if fitted.trace else 0.0 for v in fitted.values]
    return whiten(rows, fitted, key, vector).select(
        key, "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("component") - 1).alias("explained"),
        F.lit(identity_error(rows, fitted, vector)).alias("identity_error"),
    )
