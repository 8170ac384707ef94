"""Graphs that one task holds give what the loops of joins give, and take a few jobs however long their paths are."""

import random

import pyarrow as pa
import pytest

from estatelens.operators import graph, whole
from estatelens.session import written

EDGES, SEEDS = "model_id string, src string, dst string", "model_id string, node string, word long, bits long"


def counted(monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "checkpoint", lambda df: kept.append(1) or written(df))
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: kept.append(1) or cut(df))
    monkeypatch.setattr(graph, "_settle", lambda df, write=None, settle=graph._settle: settle(df, write or graph.cut))
    return kept


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_whole_graphs_as_in_rounds(spark, monkeypatch, seed):
    """Two models with the same names, edges to oneself and twice, seeds and marks on nodes without edges."""
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    rows = [(m, rng.choice(names), rng.choice(names)) for m in "pq" for _ in range(55)] + [("p", "n00", "n00"), ("p", "n01", "n02"), ("p", "n01", "n02")]
    rows += [("q", f"z{i}", f"z{(i + 1) % 9}") for i in range(9)] + [("q", "z3", "n05"), ("q", "n07", "z8")]
    edges = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([("p", "n03"), ("q", "z1"), ("q", "n11"), ("q", "n11"), ("p", "alone")], "model_id string, node string")
    marks = spark.createDataFrame([(rng.choice("pq"), rng.choice([*names, "alone", "z4"]), rng.randrange(5), 1 << rng.randrange(62)) for _ in range(40)] + [("p", "n03", 1, -(2**63))], SEEDS)

    def run():
        return (
            got(graph.reach(edges, seeds), "model_id", "node"), got(graph.cycles(edges), "model_id", "component", "node"),
            got(graph.rings(edges), "model_id", "component", "step_no", "node", "ring_length"), got(graph.spread(edges, marks), "model_id", "node", "word", "bits"),
        )

    found = run()
    monkeypatch.setattr(graph, "WHOLE_EDGES", 0)
    monkeypatch.setattr(graph.rings, "__defaults__", (None, 0))
    assert found == run()
    assert all(found)


def test_rings_take_few_jobs(spark, monkeypatch):
    """A ring of 200 nodes beside short ones: its steps are walked in a task."""
    kept = counted(monkeypatch)
    rows = [("m", f"a{i:03d}", f"a{(i + 1) % 200:03d}") for i in range(200)] + [("m", f"b{k}{i}", f"b{k}{1 - i}") for k in range(30) for i in range(2)]
    found = got(graph.rings(spark.createDataFrame(rows, EDGES)), "component", "step_no", "node", "ring_length")
    assert found == sorted([("a000", i, f"a{i:03d}", 200) for i in range(200)] + [(f"b{k}0", i, f"b{k}{i}", 2) for k in range(30) for i in range(2)])
    assert len(kept) < 12


def test_reach_and_marks_take_few_jobs(spark, monkeypatch):
    """Paths of 300 edges."""
    kept = counted(monkeypatch)
    edges = spark.createDataFrame([("m", f"p{i}", f"p{i + 1}") for i in range(300)], EDGES)
    assert graph.reach(edges, spark.createDataFrame([("m", "p1")], "model_id string, node string")).count() == 300
    found = graph.spread(edges, spark.createDataFrame([("m", "p300", 7, 5), ("m", "p10", 7, 8)], SEEDS))
    assert got(found, "node", "word", "bits") == sorted((f"p{i}", 7, 13 if i <= 10 else 5) for i in range(301))
    assert len(kept) < 14


def test_words_are_spread_in_pieces(monkeypatch):
    """Far more pairs than a piece holds; a word never lies in two pieces."""
    monkeypatch.setattr(whole, "PAIRS", 50)
    made = whole.condensed([pa.RecordBatch.from_pydict({"a": list(range(100)), "b": list(range(1, 101))})])
    table = pa.Table.from_batches(list(made))
    numbers = {h: at for h, at in zip(*(table.column(c).to_pylist() for c in ("h", "at")), strict=True) if h is not None}
    seeds = pa.RecordBatch.from_pydict({"at": [numbers[100], numbers[100], numbers[40], numbers[7]], "word": [3, 1, 1, 9], "bits": [1, 2, 4, 8]})
    parts = [b.to_pydict() for b in whole.Layers(table.filter(pa.compute.is_null(table.column("h")))).run([seeds])]
    rows = sorted((n, w, b) for p in parts for n, w, b in zip(p["at"], p["word"], p["bits"], strict=True))
    expected = [(numbers[i], 3, 1) for i in range(101)] + [(numbers[i], 1, 6 if i <= 40 else 2) for i in range(101)] + [(numbers[i], 9, 8) for i in range(8)]
    assert rows == sorted(expected)
    assert whole.Layers(table.filter(pa.compute.is_null(table.column("h")))).n == 101 and list(whole.Layers(table.slice(0, 0)).run([seeds.slice(0, 0)])) == []
