"""Nearest neighbours and the Jaccard join against brute force, and the pipeline stage by stage."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from estatelens.llm import common, jaccard, neighbours


def brute(rows, bound):
    """{doc_id: (set size, smallest reachable id)}."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id].append(frozenset(tuple(w[i : i + bound.words]) for i in range(max(1, len(w) - bound.words + 1))) if w else frozenset())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= bound.percent * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i in ids for s in sets[i]}


@pytest.mark.parametrize("bound", [jaccard.Bound(3, 90), jaccard.Bound(5, 80), jaccard.Bound(2, 50)])
def test_jaccard_components(spark, small, bound):
    chain = [" ".join(str(x) for x in range(k, k + 40)) for k in range(0, 30, 2)]
    family = [" ".join("q%d" % ((7 * i if j == i * 3 else 0) + j) for j in range(60)) for i in range(12)]
    extra = [(5000 + i, t) for i, t in enumerate([*chain, *family, "a b", "A  B", "a", "", None, "a b"])]
    docs = small("documents").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = {tuple(r) for r in jaccard.join(docs, bound).collect()}
    assert found == brute([tuple(r) for r in docs.collect()], bound)


def test_jaccard_awkward_rows(awkward, nothing):
    rows = [tuple(r) for r in awkward.where("doc_id is not null").select("doc_id", "text").collect()]
    known = {tuple(r) for r in jaccard.join(awkward).where("doc_id is not null").collect()}
    assert known == brute(rows, jaccard.Bound())
    assert jaccard.join(nothing).count() == 0 and jaccard.join(awkward).count() == awkward.count()
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_orders_are_total_and_rare_first():
    sets = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64))
    often = sets[10:20]
    common = np.sort(((often >> np.uint64(32)).astype(np.int64) << 8) | 5)
    for seed in range(jaccard.ORDERS):
        order = jaccard.prefix(sets, jaccard.frequency(sets, common), len(sets), seed)
        assert set(order) == set(sets) and set(order[-10:]) == set(often)
        assert (jaccard.prefix(sets, jaccard.frequency(sets, common), 50, seed) == order[:50]).all()


def test_frequencies_are_summed_in_little_memory():
    """Blocks of hashes with small and large counts; at most 40 bytes a hash at once, and workers give back what they held."""
    rng, blocks, total = np.random.default_rng(3), [], defaultdict(int)
    for _ in range(40):
        hashes = np.unique(rng.integers(0, 1 << 18, 20_000)).astype(np.uint32) * np.uint32(7)
        times = np.where(rng.random(len(hashes)) < 0.01, 100_000, rng.integers(1, 255, len(hashes)))
        blocks.append((jaccard.packed(hashes), jaccard.counts_packed(times)))
        for h, n in zip(hashes.tolist(), times.tolist(), strict=True):
            total[h] += n
    columns = [pa.array([b[k] for b in blocks], pa.binary()) for k in (0, 1)]
    tracemalloc.start()
    values, n = jaccard.summed(*columns)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(values.tolist(), n.tolist(), strict=True)) == total and (np.diff(values.astype(np.int64)) > 0).all()
    assert most < 40 * sum(len(jaccard.counts_unpacked(c)) for _, c in blocks)
    common.release()


def nearest(rows, queries, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = set()
    for q, v in rows:
        if q in queries:
            scored = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in rows if i != q)[:k]
            out |= {(q, n + 1, i) for n, (_, i) in enumerate(scored)}
    return out


def test_neighbours_recall(small):
    vectors = small("embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    verified = vectors.sparkSession.sparkContext.accumulator(0)
    found = neighbours.search(vectors, F.col("vec_id") % 10 == 0, tell=verified.add).collect()
    expected = nearest(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    got = {(r.query_id, r["rank"], r.vec_id) for r in found}
    pairs = lambda x: {(a, c) for a, _, c in x}
    assert len(pairs(got) & pairs(expected)) >= 0.95 * len(expected) and len(got) == len(expected)
    assert 0 < verified.value < 0.9 * len({q for q, _, _ in expected}) * len(rows)  # the test stops the search; the more vectors, the sooner
    of = dict(rows)
    for r in found:
        a, b = np.array(of[r.query_id], float), np.array(of[r.vec_id], float)
        assert r.score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_neighbours_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0]),
        (9, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (11, []), (None, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as entry", "1 as vector", "2 as ids")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(frame, F.lit(True), 2).collect())
    assert found == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (8, 1, 0), (8, 2, 1), (9, 1, 0), (9, 2, 1)]
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, 0.0, 1.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found[0] == [1, 2, 3, 4, 5] and found[250] == [0, 1, 2, 3, 4] and len(found[1000]) == 5


def test_pipeline_stages(spark, small):
    from estatelens.llm import bpe, decontamination, pii

    sf_dir = "/root/testdata/sf0.001"
    docs = small("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.settle(stage(spark, kept, sf_dir), name)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "near_duplicates":
            expected = brute([tuple(r) for r in kept.select("doc_id", "text").collect()], jaccard.Bound(5, 80))
            assert ids == {i for i, size, root in expected if i == root}
        elif name == "decontamination":
            hit = {r.doc_id for r in decontamination.report(kept, small("benchmark")).where("contaminated").collect()}
            assert ids == {r.doc_id for r in kept.collect()} - hit
        elif name == "personal_data":
            assert ids == {r.doc_id for r in kept.collect()}
            assert pii.report(after).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
        kept = after
    last = corpus_pipeline.STAGES[4][1](spark, kept, sf_dir)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, bpe.round_trip(kept).collect()))
