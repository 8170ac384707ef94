"""Approximate nearest neighbours by cosine: low-dimensional 2-stable projections in a kd-tree, verified until a chi-square test holds.

Unit vectors are projected on PROJECTED Gaussian directions.  The squared projected distance over the squared true one follows a chi-square
distribution, so once the k-th true distance found is d, a vector nearer than d lies farther than d * sqrt(quantile) in the projection with
probability 1 - SURE only: there the search stops.

The upper kd-tree is fitted on a bounded sample, every vector is filed in one of its cells.  A query searches its own cell, then the cells next
to it, then all others that the test leaves; each cell holds a kd-tree of its own.  Its buckets that the test leaves give their points in the order of projected distance, which
are verified STEP at a time until the next point fails the test.  Cells beyond CELL_ROWS are dealt in blocks, and the queries of a cell beyond QUERY_ROWS
in parts, so a block is copied once for each part of its own cell's queries.  Equal vectors are one entry with their smallest ids.

PROJECTED and SURE are set by measurement: ``tests/llm/test_pairs.py`` holds recall against brute force at 0.9 or more, and the share of vectors that are verified
well below all.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than most; ties
go to the smaller id; fewer neighbours where there are fewer candidates; repeated rows of an id are one; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import settle

PROJECTED, SURE, SEED = 32, 0.96, 20
#: Vectors that the upper tree is fitted on; rows of a cell's block, of a block of queries, and of a bucket.
SAMPLE, CELL_ROWS, QUERY_ROWS, BUCKET = 20_000, 8_192, 4_096, 64
#: Points verified between two tests.
STEP = 16
#: Cells that a query searches after its own before it asks for all the rest.
NEXT_CELLS = 4
SALTS = 32


def chi_square_quantile(share: float, degrees: int) -> float:
    """For an even number of degrees, whose distribution is a finite sum; by bisection."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 100.0 + 10 * degrees
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


QUANTILE = chi_square_quantile(SURE, PROJECTED)


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, PROJECTED))


def project(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ directions(vectors.shape[1])


class KdTree:
    """Median splits of points down to cells of at most ``rows``; ``low`` and ``high`` are the cells' borders."""

    def __init__(self, points: np.ndarray, rows: int, tight: bool):
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, children; a child below 0 is cell -1 - child
        self.members: list[np.ndarray] = []
        low, high = [], []

        def build(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            own = points[at]
            spread = own.max(axis=0) - own.min(axis=0) if len(at) else np.zeros(points.shape[1])
            dim = int(spread.argmax())
            value = float(np.median(own[:, dim])) if len(at) else 0.0
            left = at[own[:, dim] < value] if len(at) > rows else at
            if len(at) <= rows or not 0 < len(left) < len(at):
                self.members.append(at)
                low.append(own.min(axis=0) if tight and len(at) else lo)
                high.append(own.max(axis=0) if tight and len(at) else hi)
                return -len(self.members)
            number = len(self.splits)
            self.splits.append((dim, value, 0, 0))
            upto, beyond = hi.copy(), lo.copy()
            upto[dim] = beyond[dim] = value
            self.splits[number] = (dim, value, build(left, lo, upto), build(at[own[:, dim] >= value], beyond, hi))
            return number

        edge = np.full(points.shape[1], np.inf)
        self.root = build(np.arange(len(points)), -edge, edge)
        self.low, self.high = np.array(low), np.array(high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        """Each point's cell."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            dim, value, left, right = self.splits[node]
            less = points[at, dim] < value
            todo += [(left, at[less]), (right, at[~less])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every cell's borders."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)


def usable(vector: Column) -> Column:
    """Not null or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _entries(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, entry)``, and ``(entry, ids, vector)``: equal vectors are one entry with their k + 1 smallest ids."""
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usual = sizes[0]["n"] if sizes else 0

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw = [(np.array(v, np.float64) + 0.0).tobytes() for v in part.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "entry", "vector"])

    named = settle(valid.where(F.size("v") == usual).mapInArrow(name, "vec_id long, entry binary, vector binary"), "vectors")
    ids = named.select("vec_id", "entry").distinct()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    some = ids.withColumn("_n", F.row_number().over(Window.partitionBy("entry", salt).orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    few = some.withColumn("_n", F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    kept = few.groupBy("entry").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    content = named.groupBy("entry").agg(F.first("vector").alias("vector"))
    return ids, settle(kept.join(content, "entry"), "entries")


def _search(queries: pa.Table, rows: pa.Table, k: int, tell: Callable[[int], None] = lambda n: None) -> pa.Table:
    """The best ``k`` entries of a block for each query, verified in the order of projected distance until the test holds; ``tell`` gets how many were."""
    found: list[tuple] = []
    verified = 0
    if queries.num_rows and rows.num_rows:
        data = np.stack([np.frombuffer(v) for v in rows.column("vector").to_pylist()])
        names, least = rows.column("entry").to_pylist(), rows.column("least").to_numpy()
        norms = np.linalg.norm(data, axis=1)
        points = project(data)
        tree = KdTree(points, BUCKET, tight=True)
        for query, vector, reach in zip(queries.column("query").to_pylist(), queries.column("vector").to_pylist(), queries.column("reach").to_pylist(), strict=True):
            v = np.frombuffer(vector)
            own = project(v[None, :])[0]
            near = np.concatenate([np.zeros(0, np.int64), *(tree.members[b] for b in np.flatnonzero(tree.distances(own) <= reach * QUANTILE))])
            far = ((points[near] - own) ** 2).sum(axis=1)
            order = np.argsort(far, kind="stable")
            near, far = near[order], far[order]
            best_at, best = np.zeros(0, np.int64), np.zeros(0)
            for first in range(0, len(near), STEP):
                if far[first] > reach * QUANTILE:
                    break
                at = near[first : first + STEP]
                verified += len(at)
                best_at, best = np.concatenate([best_at, at]), np.concatenate([best, data[at] @ v / (norms[at] * np.linalg.norm(v))])
                order = np.lexsort((least[best_at], -best))[:k]
                best_at, best = best_at[order], best[order]
                if len(best) == k:
                    reach = min(reach, 2 - 2 * best[-1])
            found += [(query, names[i], float(s), int(least[i])) for i, s in zip(best_at, best, strict=True)]
    tell(verified)
    kinds = [("query", pa.binary()), ("entry", pa.binary()), ("score", pa.float64()), ("least", pa.int64())]
    return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(kinds)})


def _visit(asked: DataFrame, filed: DataFrame, blocks: dict[int, int], k: int, tell: Callable[[int], None]) -> DataFrame:
    """``asked (query, vector, reach, cell)`` against the rows filed in those cells, block by block."""
    spark, asked = asked.sparkSession, settle(asked, "asked")
    parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("_parts"))
    counts = spark.createDataFrame([(c, n) for c, n in blocks.items()], "cell int, _blocks int")
    # As many rows as the upper tree has cells, so at most SAMPLE / 16.
    spread = asked.join(F.broadcast(counts), "cell").join(F.broadcast(parts), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("query"), F.col("_parts")).cast("int")).select("cell", "block", "part", "query", "vector", "reach")
    wanted = spread.select(*(F.col(c).alias(c) for c in ("cell", "block", "part"))).distinct()
    rows = filed.join(wanted, ["cell", "block"]).select("cell", "block", "part", "entry", "vector", "least")
    key = ["cell", "block", "part"]
    return spread.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(lambda q, r: _search(q, r, k, tell), "query binary, entry binary, score double, least long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, tell: Callable[[int], None] = lambda n: None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query among all rows but its own, by cosine in double precision.

    ``tell``, such as an accumulator's ``add``, gets the numbers of verified vectors.
    """
    ids, entries = _entries(vectors, k)
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("vector").toArrow().column("vector").to_pylist()
    cells = max(1, min(-(-n // CELL_ROWS) * 4, len(sample) // 16))
    tree = KdTree(project(np.stack([np.frombuffer(v) for v in sample])), max(16, len(sample) // cells), tight=False)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                own = shared.value.cell(project(np.stack([np.frombuffer(v) for v in part.column("vector").to_pylist()])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32())], ["entry", "vector", "least", "cell"])

    filed = settle(entries.select("entry", "vector", F.get("ids", F.lit(0)).alias("least")).mapInArrow(file, "entry binary, vector binary, least long, cell int"), "filed")
    blocks = {r["cell"]: -(-r["n"] // CELL_ROWS) for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = F.lit(1)
    for cell, count in blocks.items():
        if count > 1:
            of = F.when(F.col("cell") == cell, count).otherwise(of)
    filed = filed.withColumn("block", F.pmod(F.xxhash64("entry"), of).cast("int"))
    asking = ids.where(is_query).select(F.col("vec_id").alias("query_id"), "entry")
    queries = settle(asking.select("entry").distinct().join(filed, "entry").select(F.col("entry").alias("query"), "vector", F.lit(8.0).alias("reach"), "cell"), "queries")
    wanted = k + 1
    top = Window.partitionBy("query").orderBy(F.desc("score"), "least")

    def best(found: DataFrame) -> DataFrame:
        return settle(found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= wanted).drop("_n"), "found")

    def others(first: int, last: int | None) -> DataFrame:
        """The cells of each query that the test leaves, from the first-th nearest on; each query's own is the nearest."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                rows = []
                for query, vector, reach, own in zip(*(part.column(c).to_pylist() for c in ("query", "vector", "reach", "cell")), strict=True):
                    far = shared.value.distances(project(np.frombuffer(vector)[None, :])[0])
                    far[own] = -1
                    rows += [(query, vector, reach, int(c)) for c in np.argsort(far, kind="stable")[first:last] if far[c] <= reach * QUANTILE]
                kinds = [("query", pa.binary()), ("vector", pa.binary()), ("reach", pa.float64()), ("cell", pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [x for x, _ in kinds])

        reach = found.groupBy("query").agg(F.count(F.lit(1)).alias("_n"), (2 - 2 * F.min("score")).alias("_reach"))
        known = queries.join(reach, "query", "left").withColumn("reach", F.when(F.col("_n") >= wanted, F.greatest("_reach", F.lit(1e-12))).otherwise(F.col("reach")))
        return known.select("query", "vector", "reach", "cell").mapInArrow(choose, "query binary, vector binary, reach double, cell int")

    found = best(_visit(queries, filed, blocks, wanted, tell))
    for first, last in ((1, 1 + NEXT_CELLS), (1 + NEXT_CELLS, None)):
        found = best(found.unionByName(_visit(others(first, last), filed, blocks, wanted, tell)))
    near = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    each = asking.withColumnRenamed("entry", "query").join(near, "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
