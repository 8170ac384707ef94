"""Reference resolution, graph, usage, audit and numbering on small estates."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens import Estate
from estatelens.estate import SCHEMAS
from estatelens.operators import audit, graph, lineage, numbering, refs, roles, usage
from estatelens.plans import documents
from estatelens.sinks import csv, markdown, tables


@pytest.fixture
def build(spark):
    """An estate from partial rows; unnamed fields are empty, zero or false."""
    blank = {"string": "", "boolean": False, "int": 0, "bigint": 0, "double": 0.0, "array<string>": []}

    def make(**frames):
        made = {}
        for name, given in frames.items():
            fields = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
            full = [tuple(r.get(n, "m" if n == "model_id" else blank[k]) for n, k in fields) for r in given]
            made[name] = spark.createDataFrame(full, SCHEMAS[name])
        return Estate(spark, made)

    return make


def m(name, body="1", table="T", **more):
    return {"table_name": table, "name": name, "body": body, **more}


def broken(rows, e):
    return rows(refs.broken_references(e.measures, e.columns, e.calc_items, e.functions), "where", "broken", "reason")


def test_broken_references(build, rows):
    columns = [{"table_name": "Orders", "name": "Qty"}]
    fine = ["SUM(orders[QTY])", "[BASE] + 1", "Orders[Base]", "RANKX(ALL(Orders), [Qty])", "1 // Gone[x]", 'EXTERNALMEASURE("A.[b]", INTEGER, "DirectQuery to AS - Z") + Gone[x]']
    e = build(columns=columns, measures=[m("Base", table="Other")] + [m(f"f{n}", b) for n, b in enumerate(fine)])
    assert broken(rows, e) == []
    e = build(
        columns=columns, measures=[m("a", "SUM(Gone[Qty])"), m("b", "SUM(Orders[Nope])"), m("c", "[Ghost]")],
        calc_items=[{"group_name": "G", "name": "i", "body": "CALCULATE([Ghost], Days[d])"}], functions=[{"name": "F", "body": "SUM(Lost[c])"}],
    )
    assert broken(rows, e) == [
        ("Function F", "Lost[c]", "table not in model"), ("G · i", "Days[d]", "table not in model"), ("G · i", "[Ghost]", "measure/column not found"),
        ("T[a]", "Gone[Qty]", "table not in model"), ("T[b]", "Orders[Nope]", "column not on table"), ("T[c]", "[Ghost]", "measure/column not found")]


def test_models_do_not_see_each_other(build, rows):
    e = build(measures=[m("A", "[B]"), m("B", model_id="other")])
    assert rows(refs.dependencies(e.measures), "src", "dst") == [] and broken(rows, e)[0][1] == "[B]"


def binding(seq, name, page="p", visual="v", role="Y", kind="measure", **more):
    return {"seq": seq, "page_id": page, "visual_id": visual, "role": role, "field_type": kind, "table_name": "T", "field_name": name, **more}


def test_compat_and_strict_status(build, rows):
    e = build(measures=[m("A", '[B] & "[C]" // [D]'), m("B"), m("C"), m("D"), m("Dead", "[DeadHelper]"), m("DeadHelper")], bindings=[binding(1, "A")])
    strict = dict(rows(usage.measure_status(e), "name", "status"))
    compat = dict(rows(usage.measure_status(e, "compat"), "name", "status"))
    assert strict == {"A": "direct", "B": "indirect", "C": "unused", "D": "unused", "Dead": "unused", "DeadHelper": "unused"}
    assert compat == {**strict, "C": "indirect", "D": "indirect"}
    edges = refs.dependencies(e.measures)
    assert dict(rows(usage.orphans(usage.measure_status(e), edges), "name", "orphan")) == {"C": "pure", "D": "pure", "Dead": "pure", "DeadHelper": "chain"}


def test_binding_dedupe_prefers_wells(build, rows):
    e = build(measures=[m("A")], columns=[{"table_name": "T", "name": "c"}], bindings=[
        binding(1, "A", role="Filter"), binding(2, "A", role="Y"), binding(3, "A", visual="w", role="Filter"), binding(4, "A", page="q"),
        binding(5, "c", kind="aggregation", visual_type="listSlicer"), binding(6, "c", kind="column", role="Filter")])
    assert rows(usage.deduped_bindings(e.bindings), "field_name", "page_id", "visual_id", "role", "seq") == [
        ("A", "p", "v", "Y", 2), ("A", "p", "w", "Filter", 3), ("A", "q", "v", "Y", 4), ("c", "p", "v", "Y", 5)]
    assert rows(usage.field_usage(e.bindings), "field_name", "usage_count", "page_count", "is_slicer_field") == [("A", 3, 2, False), ("c", 1, 1, True)]


def test_binding_dedupe_gives_one_row_for_ties_and_nulls(spark, build, rows):
    e = build(measures=[m("A")], bindings=[binding(1, "A", role="Y"), binding(1, "A", role="X"), binding(1, "A", role="Y"), binding(2, "A", page="q")])
    no_page = e.bindings.withColumn("page_id", F.when(F.col("page_id") != "q", F.col("page_id"))).unionByName(
        e.bindings.where("page_id = 'q'").withColumns({"page_id": F.lit(None).cast("string"), "visual_id": F.lit("w"), "seq": F.lit(None).cast("long")}))
    assert rows(usage.deduped_bindings(no_page), "page_id", "visual_id", "role", "seq") == [("p", "v", "X", 1), (None, "v", "Y", 2), (None, "w", "Y", None)]


def edges_of(spark, pairs):
    return spark.createDataFrame([("m", a, b) for a, b in pairs], "model_id string, src string, dst string")


def test_dead_chains_need_a_given_status(spark, rows):
    edges = edges_of(spark, [("Live", "Help"), ("Help", "Leaf"), ("Off", "OffHelp")])
    status = [("Live", "direct"), ("Help", "indirect"), ("Leaf", "indirect"), ("Off", "unused"), ("OffHelp", "indirect")]
    frame = spark.createDataFrame([("m", *s) for s in status], "model_id string, name string, status string")
    assert rows(graph.dead_chains(edges, frame), "name") == [("OffHelp",)]


@pytest.mark.parametrize("seed", range(4))
def test_graph_against_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(34)}
    after = {a: {b for x, b in pairs if x == a} for a in names}

    def closure(start):
        seen, todo = set(), list(start)
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    seeds = names[:2]
    frame = spark.createDataFrame([("m", s) for s in seeds], "model_id string, node string")
    assert rows(graph.reach(edges_of(spark, pairs), frame), "node") == sorted((n,) for n in closure(seeds) | set(seeds))
    loops = {(a, b) for a, b in pairs if a != b}
    after = {a: {b for x, b in loops if x == a} for a in names}
    reach = {a: closure([a]) for a in names}
    expected = sorted((min(b for b in reach[a] if a in reach[b]), a) for a in names if a in reach[a])
    for small in (0, graph.SMALL_CORE):  # the loop over the whole graph and a task for each model
        assert rows(graph.cycles(edges_of(spark, pairs), small), "component", "node") == expected


def test_long_chain(spark):
    chain = edges_of(spark, [(f"c{i}", f"c{i + 1}") for i in range(45)])
    seed = spark.createDataFrame([("m", "c0")], "model_id string, node string")
    assert graph.reach(chain, seed).count() == 46 and graph.cycles(chain).count() == 0


def test_long_ring_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: rounds.append(1) or settle(df))
    ring = edges_of(spark, [(f"c{i:04d}", f"c{(i + 1) % 200:04d}") for i in range(200)])
    found = graph.cycles(ring, small=0)
    assert found.count() == 200 and found.select("component").distinct().count() == 1
    assert len(rounds) < 40


def test_small_frontier_is_broadcast(spark):
    chain = edges_of(spark, [(f"c{i}", f"c{i + 1}") for i in range(45)])
    seed = spark.createDataFrame([("m", "c0")], "model_id string, node string")
    plan = graph._follow(chain, graph.broadcast_if_small(seed, 10))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_apostrophe_hides_no_function(spark, rows):
    functions = spark.createDataFrame([("m", "Helper"), ("m", "Calc")], "model_id string, name string")
    measures = spark.createDataFrame([("m", "T", "A", "// don't touch 'Helper'\nCalc(1)"), ("m", "T", "B", "'Helper"), ("m", "T", "C", "")], "model_id string, table_name string, name string, body string")
    assert rows(refs.function_uses(functions, measures), "function", "measure") == [("Calc", "A"), ("Helper", "A")]


def test_numbering_against_brute_force(spark):
    rng = random.Random(7)
    given = [("m", "hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", f"v{i:04d}") for i in range(900)]
    frame = spark.createDataFrame(given, "model_id string, g string, v string").repartition(7)
    numbered = {(r["g"], r["v"]): r["row_no"] for r in numbering.number_rows(frame, ["model_id", "g"], [F.col("v").desc()]).collect()}
    for group in {g for _, g, _ in given}:
        for n, v in enumerate(sorted((v for _, g, v in given if g == group), reverse=True), start=1):
            assert numbered[group, v] == n
    capped = numbering.capped(frame, ["model_id", "g"], [F.col("v").asc()], 3).where("g = 'hot'").collect()
    hot = sum(g == "hot" for _, g, _ in given)
    assert sorted(r["item_no"] for r in capped) == [1, 2, 3] and {r["more"] for r in capped} == {hot - 3}


def test_duplicates_and_long_bodies(build, rows):
    e = build(measures=[m("A", "SUM(Orders[Qty]) + 1"), m("B", "SUM(Orders[Qty])  +\n 1"), m("C", "SUM( Orders[Qty]) + 1"), m("D", "1"), m("E", "1"), m("L", "x\n" * 30), m("S", "x\n\n" * 29)])
    assert rows(audit.duplicate_bodies(e.measures), "name", "copies") == [("A", 2), ("B", 2)]
    assert rows(audit.long_bodies(e.measures), "name", "body_lines") == [("L", 30)]


def test_inactive_relationships(build, rows):
    rel = {"from_table": "F", "from_column": "k", "to_table": "D", "to_column": "id"}
    e = build(relationships=[{**rel, "rel_no": 1}, {**rel, "rel_no": 2, "from_column": "z"}], measures=[m("A", "CALCULATE([x], userelationship( D[id] , Other[K] ))")])
    assert rows(refs.inactive_without_caller(e.relationships, e.measures), "from_column") == [("z",)]
    assert rows(refs.inactive_without_caller(e.relationships, e.measures, "strict"), "from_column") == [("k",), ("z",)]


def test_roles_and_kinds(build, rows):
    def rel(a, b, n):
        return {"rel_no": n, "from_table": a, "from_column": "k", "to_table": b, "to_column": "id", "is_active": True}

    names = ["F", "B", "D", "X", "P", "Q", "LocalDateTable_1"]
    e = build(
        columns=[{"table_name": t, "name": "P" if t == "P" else "id", "has_param_metadata": t == "Q"} for t in names] + [{"table_name": "G", "name": "Name"}],
        measures=[m("A", table="My Measures")], relationships=[rel("F", "B", 1), rel("B", "D", 2)], calc_items=[{"group_name": "G", "name": "i"}],
        partitions=[{"table_name": "P", "mode": "directQuery", "kind": "entity", "expression_source": "DirectQuery to AS - R"}, {"table_name": "X", "kind": "calculated", "mode": "import"}],
    )
    summary = roles.table_summary(e)
    assert dict(rows(summary, "table_name", "role")) == {
        "F": "Fact", "B": "Bridge", "D": "Dimension", "X": "Disconnected", "P": "Disconnected", "Q": "Disconnected", "G": "Calculation Group",
        "My Measures": "Disconnected", "LocalDateTable_1": "Auto-date"}
    assert dict(rows(summary.select("table_name", roles.table_group().alias("g")), "table_name", "g")) == {
        "F": "data", "B": "data", "D": "data", "X": "data", "P": "proxy", "Q": "field-param", "G": "calcgroup", "My Measures": "measure", "LocalDateTable_1": "data"}
    assert rows(summary.where("is_calculated"), "table_name") == [("X",)]


def test_audit_findings(build, rows):
    e = build(
        models=[{"name": "M"}], columns=[{"table_name": "T", "name": "url", "data_type": "int64", "data_category": "WebUrl"}, {"table_name": "DateTableTemplate_1", "name": "d"}],
        measures=[m("A", "[B]"), m("B", "[A]"), m("Self", "[Self]")], pages=[{"page_id": "p", "name": "Empty"}, {"page_id": "h", "name": "Hidden", "hidden": True}],
    )
    found = audit.Audit(e)
    checks = {(r["check_id"], r["entity"]) for r in found.findings().collect()}
    assert {("A1", "DateTableTemplate_1"), ("A2", "A"), ("A2", "B"), ("A13", "Empty"), ("A14", "T[url]"), ("A16", "m"), ("A17", "T[url]"), ("A5", "T[Self]")} <= checks
    assert ("A2", "Self") not in checks and ("A13", "Hidden") not in checks and not any(c == "A23" for c, _ in checks)
    assert rows(audit.category_mismatches(e.columns, "compat"), "name") == []


def test_lineage_and_search(build, rows):
    e = build(measures=[m("Total", "SUM(T[c])"), m("Total 2", "[Total]")], columns=[{"table_name": "T", "name": "c"}, {"table_name": "U", "name": "c"}], bindings=[binding(1, "Total 2")])
    found = lineage.lineage_edges(e)
    assert rows(found.where("entity = 'T[Total]'"), "direction", "related_kind", "related") == [("feeds", "measure", "T[Total 2]"), ("upstream", "table", "T")]
    assert rows(found.where("entity = 'U[c]'"), "related") == [("U",)]
    assert rows(refs.column_mentions(e.measures, e.columns), "table_name", "measures") == [("T", 1), ("U", 1)]
    status = usage.measure_status(e)
    hits = lineage.search(lineage.searchable(status, usage.column_status(e, status)), "total").collect()
    assert [(r["name"], r["match"]) for r in hits] == [("Total", 0), ("Total 2", 1)]


def test_writers(build, rows, spark, tmp_path):
    e = build(models=[{"name": "M"}, {"model_id": "n", "name": "N"}], columns=[{"table_name": "T", "name": "c"}], measures=[m("A|x", '"q", [B]', description="two\nlines"), m("B"), m("Z", model_id="n")])
    tables.write_tables(e, str(tmp_path / "estate"))
    back = Estate.read(spark, str(tmp_path / "estate"))
    assert rows(back.measures, "model_id", "name", "body") == rows(e.measures, "model_id", "name", "body")
    csv.write_csv(csv.measure_rows(e, usage.measure_status(e)), str(tmp_path / "csv"))
    written = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert ("A|x", '"q", [B]', "two\nlines") in rows(written, "Measure", "DAX", "Description")
    lines = documents.documents(back, "lite")
    assert {r["doc"] for r in lines.select("doc").distinct().collect()} == {"Model", "Sources", "Measures", "Pages", "Improvements"}
    markdown.write_markdown(documents.measures_doc(e, usage.measure_status(e)), str(tmp_path / "md"))
    text = (tmp_path / "md" / "model_id=m" / "Measures.md").read_text()
    assert text.splitlines() == ["## Measures", "", "| Name | Table | Status | Format | Description |", "|---|---|---|---|---|",
                                 '| <a id="a-x"></a>A\\|x | T | unused | — | two lines |', '| <a id="b"></a>B | T | unused | — | — |']
