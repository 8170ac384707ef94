"""Cycle paths, spreading marks, transitive impact, links of documents, document files and deep brackets."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from estatelens.estate import SCHEMAS, Estate
from estatelens.functions import etl
from estatelens.operators import graph, impact, links, numbering, refs
from estatelens.sinks import markdown, tables


def edges_of(spark, pairs):
    return spark.createDataFrame([(*p,) if len(p) == 3 else ("m", *p) for p in pairs], "model_id string, src string, dst string")


def shortest_ring(after, inside, start):
    """Breadth first from ``start`` within its component; of several ways to a node the smallest predecessor."""
    depth, parent, todo = {start: 0}, {}, deque([start])
    while todo:
        node = todo.popleft()
        for b in after[node] & inside:
            if b not in depth:
                depth[b] = depth[node] + 1
                todo.append(b)
    for b in inside - {start}:
        parent[b] = min(a for a in inside if b in after[a] and depth[a] == depth[b] - 1)
    length = min(depth[a] for a in inside if start in after[a]) + 1
    path = [min(a for a in inside if start in after[a] and depth[a] == length - 1)]
    while path[-1] != start:
        path.append(parent[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("seed", range(2))
def test_rings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(52)} | {("z0", "z1"), ("z1", "z0"), ("n00", "n00")}
    pairs |= {(f"r{i:02d}", f"r{(i + 1) % 23:02d}") for i in range(23)}
    loops = {(a, b) for a, b in pairs if a != b}
    after = {a: {b for x, b in loops if x == a} for p in pairs for a in p}
    members = {}
    for r in graph.cycles(edges_of(spark, pairs)).collect():
        members.setdefault(r["component"], set()).add(r["node"])
    found = {}
    for r in sorted(graph.rings(edges_of(spark, pairs)).collect(), key=lambda r: r["step_no"]):
        found.setdefault(r["component"], []).append(r["node"])
        assert r["model_id"] == "m"
    assert found == {start: shortest_ring(after, inside, start) for start, inside in members.items()}
    assert len(found["r00"]) == 23 and found["z0"] == ["z0", "z1"]


def test_no_rings_and_models_apart(spark):
    assert graph.rings(edges_of(spark, [("a", "b"), ("b", "c")])).count() == 0
    split = [("m", "a", "b"), ("n", "b", "a"), ("o", "a", "b"), ("o", "b", "a")]
    assert sorted(map(tuple, graph.rings(edges_of(spark, split)).collect())) == [("o", "a", 0, "a", 2), ("o", "a", 1, "b", 2)]


def test_marks_spread_through_cycles(spark, rows):
    pairs = [("c", "b"), ("b", "a"), ("a", "b"), ("d", "c"), ("x", "y")]
    seeds = spark.createDataFrame([("m", "a", 0, 1), ("m", "b", 0, 2), ("m", "b", 3, -(2**63)), ("n", "c", 0, 4)], "model_id string, node string, word long, bits long")
    found = graph.spread(edges_of(spark, pairs), seeds)
    top = -(2**63)
    assert rows(found, "model_id", "node", "word", "bits") == sorted(
        [("m", n, 0, 3) for n in "abcd"] + [("m", n, 3, top) for n in "abcd"] + [("n", "c", 0, 4)], key=str
    )
    assert rows(graph.marked(found, "n"), "model_id", "mark", "n") == sorted([("m", 0, 4), ("m", 1, 4), ("m", 255, 4), ("n", 2, 1)], key=str)


def test_transitive_impact_of_several_models(spark, rows):
    """Names clash between the models; only the second one's measure on top is shown on a page."""
    def body(server):
        return f'let S = Sql.Database("{server}", "d") in S'

    frames = {name: [] for name in SCHEMAS}
    for model in ("m", "n"):
        frames["measures"] += [
            {"model_id": model, "table_name": "T", "name": "base", "body": "SUM(T[c])"}, {"model_id": model, "table_name": "K", "name": "mid", "body": "[base]"},
            {"model_id": model, "table_name": "K", "name": "top", "body": "[mid] + [top2]"}, {"model_id": model, "table_name": "K", "name": "top2", "body": "[top]"},
            {"model_id": model, "table_name": "K", "name": "named", "body": "SUM(U[c])" if model == "m" else "1"},
        ]
        frames["columns"] += [{"model_id": model, "table_name": t, "name": "c"} for t in "TU"]
        frames["partitions"] += [{"model_id": model, "table_name": t, "part_no": 0, "name": t, "mode": "import", "kind": "m", "m_body": body("s" + t)} for t in "TU"]
    frames["bindings"] = [
        {"model_id": "n", "seq": 1, "page_id": "p", "visual_id": "v", "role": "Values", "field_type": "measure", "table_name": "K", "field_name": "top"},
        {"model_id": "n", "seq": 2, "page_id": "p", "visual_id": "w", "role": "Values", "field_type": "column", "table_name": "T", "field_name": "c"},
        {"model_id": "n", "seq": 3, "page_id": "q", "visual_id": "v", "role": "Values", "field_type": "measure", "table_name": "K", "field_name": "gone"},
    ]
    estate = Estate(spark, {n: spark.createDataFrame([tuple(r.get(f.split()[0]) for f in SCHEMAS[n].split(", ")) for r in frame], SCHEMAS[n]) for n, frame in frames.items() if frame})
    sources = impact.inferred_sources(impact.resolve_partitions(estate.partitions, estate.expressions))
    found = impact.transitive_impact(estate, sources, refs.dependencies(estate.measures))
    named = found.withColumn("source", F.regexp_extract("source_key", r"\|(s[TU])\|", 1))
    assert rows(named, "model_id", "source", "tables", "direct_measures", "measures", "visuals", "pages") == sorted([
        ("m", "sT", 1, 1, 4, 0, 0), ("m", "sU", 1, 1, 1, 0, 0), ("n", "sT", 1, 1, 4, 2, 1), ("n", "sU", 1, 0, 0, 0, 0),
    ], key=str)


def lines_of(spark, *docs):
    given = [(model, doc, 1, f"{n:06d}", "", line) for model, doc, lines in docs for n, line in enumerate(lines)]
    return spark.createDataFrame(given, "model_id string, doc string, section int, key1 string, key2 string, line string").repartition(5)


def test_broken_links(spark, rows):
    lines = lines_of(
        spark,
        ("m", "A", ["# Top", "## Sales", "## Sales", '<a id="own">', '<a id="own">', '<a id="top">', "[x](#sales) [y](#sales-1) [z](#sales-2)", "```", "# Hidden", "[no](#nowhere)", "```",
                    "[e](#) and [f](B.md#)", "[g](B.md#there) [h](B.md#hidden) [i](C.md#top)", "[u](http://x/y) [v](B.md)", "[again](#sales-2)"]),
        ("m", "B", ["### There "]),
        ("n", "A", ["[g](#top)", "```", "# Top"]),
        ("n", "B", []),
    )
    assert rows(links.broken(lines), "model_id", "doc", "target", "fragment", "reason", "links") == sorted([
        ("m", "A", "A", "sales-2", "no such anchor", 2), ("m", "A", "A", "", "empty fragment", 1), ("m", "A", "B", "", "empty fragment", 1),
        ("m", "A", "B", "hidden", "no such anchor", 1), ("m", "A", "C", "top", "no such document", 1), ("m", "A", "A", "own", "repeated anchor", 2),
        ("m", "A", "A", "top", "repeated anchor", 2), ("n", "A", "A", "top", "no such anchor", 1),
    ], key=str)


def test_running_count_of_a_hot_group(spark):
    given = [("m", "hot" if i % 3 else f"g{i % 5}", i) for i in range(600)]
    frame = spark.createDataFrame(given, "model_id string, g string, v long").repartition(7)
    got = {(r["g"], r["v"]): r["n"] for r in numbering.running_count(frame, ["model_id", "g"], [F.col("v").asc()], F.col("v") % 4 == 0, "n").collect()}
    for group in {g for _, g, _ in given}:
        n = 0
        for v in sorted(v for _, g, v in given if g == group):
            n += v % 4 == 0
            assert got[group, v] == n


def test_one_file_for_each_document(spark, tmp_path):
    """A document with most of all lines lies in many ranges; names with signs are quoted; blank and null lines stay."""
    docs = [("m", "Hot", [f"line {i} é" for i in range(4000)]), ("m", "B", ["", "x", ""]), ("m/1 %", "Hot", ["other"]), ("n", "C", [None])]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        done = markdown.write_markdown(lines_of(spark, *docs), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert found == {markdown.place(m, d): "".join((x or "") + "\n" for x in given) for m, d, given in docs}
    assert {(r["model_id"], r["doc"]) for r in done.collect()} == {(m, d) for m, d, _ in docs}
    assert markdown.write_markdown(lines_of(spark, *docs).limit(0), str(tmp_path / "none")).count() == 0


def test_failed_attempts_leave_no_document(spark, tmp_path):
    """Only chunks that a committed task names are put together."""
    writer = markdown.ChunkWriter(str(tmp_path / "stage"))
    (tmp_path / "stage" / "0-7").mkdir(parents=True)
    (tmp_path / "stage" / "0-7" / "left.md").write_text("half")
    writer.commit([None, markdown.Written([("m", "A", 1, "p")])])
    assert (tmp_path / "stage" / "chunks.json").read_text() == '{"model_id": "m", "doc": "A", "part": 1, "path": "p"}\n'
    writer.abort([])
    assert not (tmp_path / "stage").exists()


@pytest.mark.parametrize("depth", [0, 1, 24, 25, 60])
def test_brackets_of_any_depth(spark, depth):
    deep = "(" * depth + 'f("a,b", (c))' + ")" * depth
    listed = "{" * (depth + 1) + '"A", {"B"}, "C ""x"""' + "}" * (depth + 1)
    bodies = [
        (f'let Q = Value.NativeQuery({deep} ,  "select ""k"", v from t", null) in Q', 'select "k", v from t'), (f"let Q = Value.NativeQuery({deep}) in Q", ""),
        (f'let Q = Value.NativeQuery({deep}, x & "no") in Q', ""), ('let Q = Value.NativeQuery(a, "open', ""), ("Value.NativeQuery(", ""),
    ]
    frame = spark.createDataFrame([(b,) for b, _ in bodies], "b string")
    assert [r[0] for r in frame.select(etl.native_query(F.col("b"))).collect()] == [want for _, want in bodies]
    steps = [(f"Table.SelectColumns(Nav, {listed}, \"later\")", 'A, B, C "x"'), (f"Table.RemoveColumns({deep}, {{}}, {listed})", ""), ('Table.SelectColumns(Nav, {"open", {"B"}', "open, B"), ("Table.SelectColumns(Nav)", "")]
    frame = spark.createDataFrame([(t,) for t, _ in steps], "t string")
    assert [r[0] for r in frame.select(etl.step_summary(F.col("t"), F.lit("projection"))).collect()] == [want for _, want in steps]


def test_one_model_opens_few_files(spark, rows, tmp_path):
    """400 models, one of them with a third of all rows: files go with the rows, and the manifest tells which to open."""
    given = [(f"m{i % 400:03d}" if i % 3 else "m007", "T", f"n{i}", "1", "", "", "") for i in range(9000)]
    measures = spark.createDataFrame(given, SCHEMAS["measures"])
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_table(measures, str(tmp_path / "measures"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = list((tmp_path / "measures").glob("*.parquet"))
    assert 8 <= len(files) <= 13
    for model in ("m001", "m007", "m399"):
        one = Estate.read(spark, str(tmp_path), [model]).measures
        assert rows(one, "name") == sorted(((r[2],) for r in given if r[0] == model), key=str)
        assert len(one.inputFiles()) <= (6 if model == "m007" else 2)
    assert Estate.read(spark, str(tmp_path), ["none"]).measures.count() == 0
    assert rows(Estate.read(spark, str(tmp_path)).measures, "model_id", "name") == rows(measures, "model_id", "name")
