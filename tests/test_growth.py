"""What loops write and how many rounds they take."""

from pyspark.sql import functions as F

from estatelens.estate import SCHEMAS, Estate
from estatelens.operators import graph, usage
from estatelens.operators.audit import Audit
from estatelens.plans import queries
from estatelens.session import written


def test_written_rounds_forget_the_estimated_size(spark):
    df = spark.range(3).withColumnRenamed("id", "a")
    for _ in range(8):
        df = written(df.join(df.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a"))
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    assert sorted(r.a for r in df.collect()) == [0, 1, 2]


def test_spread_takes_few_rounds_through_cycles(spark, monkeypatch):
    """Twelve rings of nine, each leading to the next: a mark on the last reaches all, a mark on the first only its ring."""
    rings = [(k, i) for k in range(12) for i in range(9)]
    rows = [("m", f"{k}.{i}", f"{k}.{(i + 1) % 9}") for k, i in rings] + [("m", f"{k}.4", f"{k + 1}.0") for k in range(11)]
    seeds = [("m", "11.3", 0, 1), ("m", "0.2", 0, 2), ("m", "0.2", 3, 1), ("m", "alone", 0, 4)]
    rounds = []
    monkeypatch.setattr(graph, "checkpoint", lambda df: rounds.append(1) or written(df))
    found = graph.spread(spark.createDataFrame(rows, "model_id string, src string, dst string"), spark.createDataFrame(seeds, "model_id string, node string, word long, bits long"))
    expected = {(f"{k}.{i}", 0, 3 if k == 0 else 1) for k, i in rings} | {(f"0.{i}", 3, 1) for i in range(9)} | {("alone", 0, 4)}
    assert sorted((r.node, r.word, r.bits) for r in found.collect()) == sorted(expected)
    assert len(rounds) < 15


def test_reach_takes_few_rounds(spark, monkeypatch):
    """A path of 60 edges, a ring behind it and a way back to its start: written in about 60 / 8 rounds, nodes once each."""
    kept = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: kept.append(1) or cut(df))
    monkeypatch.setattr(graph, "checkpoint", lambda df: kept.append(1) or written(df))
    monkeypatch.setattr(graph, "_settle", lambda df, write=None, settle=graph._settle: settle(df, write or graph.cut))
    path = [("m", f"p{i}", f"p{i + 1}") for i in range(60)]
    rows = path + [("m", "p60", "r0"), ("m", "p60", "p0")] + [("m", f"r{i}", f"r{(i + 1) % 3}") for i in range(3)] + [("m", "u0", "u1"), ("other", "p0", "q")]
    found = graph.reach(spark.createDataFrame(rows, "model_id string, src string, dst string"), spark.createDataFrame([("m", "p0"), ("m", "p0"), ("m", "alone")], "model_id string, node string"))
    expected = [("m", n) for n in ["alone", *(f"p{i}" for i in range(61)), "r0", "r1", "r2"]]
    assert sorted((r.model_id, r.node) for r in found.collect()) == sorted(expected)
    assert len(kept) < 14


def test_cycles_go_to_tasks_once_few_edges_are_left(spark):
    """One ring is taken off by colouring, then the rest is small enough."""
    rows = [("m", f"{k}{a}", f"{k}{b}") for k in "xyz" for a, b in ("ab", "bc", "ca")] + [("m", "xa", "ya"), ("m", "ya", "za")]
    found = graph.cycles(spark.createDataFrame(rows, "model_id string, src string, dst string"), small=8)
    assert sorted((r.component, r.node) for r in found.collect()) == [(f"{k}a", f"{k}{x}") for k in "xyz" for x in "abc"]


def test_cycles_of_many_parts_need_no_colours(spark, monkeypatch):
    """Six rings with long ways in and out, more edges than a task takes, none of them connected to another: no colouring, few rounds."""
    def no_colours(core):
        raise AssertionError("coloured")

    rounds = []
    monkeypatch.setattr(graph, "_largest_ancestor", no_colours)
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: rounds.append(1) or cut(df))
    monkeypatch.setattr(graph, "_settle", lambda df, write=None, settle=graph._settle: settle(df, write or graph.cut))
    monkeypatch.setattr(graph, "checkpoint", lambda df: rounds.append(1) or written(df))
    rows = [("m", f"{k}r{i}", f"{k}r{(i + 1) % 9}") for k in range(6) for i in range(9)]
    rows += [("m", f"{k}{way}{i}", f"{k}{way}{i + 1}" if i < 39 else f"{k}{'r3' if way == 'in' else 'end'}") for k in range(6) for way in ("in", "out") for i in range(40)]
    rows += [("m", f"{k}r5", f"{k}out0") for k in range(6)]
    found = graph.cycles(spark.createDataFrame(rows, "model_id string, src string, dst string"), small=100)
    assert sorted((r.component, r.node) for r in found.collect()) == [(f"{k}r0", f"{k}r{i}") for k in range(6) for i in range(9)]
    assert len(rounds) < 14


def test_partition_bodies_are_read_by_all_tasks(spark):
    """One task reads the table; what reads the bodies has rows in many."""
    rows = [("m", f"T{k}", k % 3, "p", "import", "m", "Shared" if k == 5 else "", f"let a = {k} in a") for k in range(200)]
    made = spark.createDataFrame(rows, SCHEMAS["partitions"]).coalesce(1)
    shared = spark.createDataFrame([("m", "Shared", "m", "let s = 1 in s", "", "")], SCHEMAS["expressions"])
    c = queries.Context.__new__(queries.Context)
    c.spark, c.e = spark, Estate(spark, {"partitions": made, "expressions": shared})
    for bodies in (c.resolved, queries.partition_texts(c)):
        assert bodies.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        assert bodies.count() == 200
    assert c.resolved.where("m_body = 'let s = 1 in s'").count() == 1
    # A filter on what is read in the bodies stays behind the dealing.
    found = c.resolved.where(F.regexp_extract("m_body", "= ([0-9]+)", 1) != "")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in found


def test_measure_status_counts_no_bindings_of_columns(spark):
    """Bindings of columns fail when they are read; what says how measures are used never reads them."""
    made = [
        spark.createDataFrame([("m", "T", n, f"[{to}]") for n, to in ("ab", "bc", "dd")], "model_id string, table_name string, name string, body string"),
        spark.createDataFrame([("m", 1, "p", "v", "card", "", "Values", "T", "a")], "model_id string, seq long, page_id string, visual_id string, visual_type string, title string, role string, table_name string, field_name string"),
    ]
    measures = made[0].withColumns({c: F.lit("") for c in ("format_string", "description", "display_folder")})
    columns = made[1].withColumns({"field_type": F.lit("column"), "field_name": F.raise_error(F.concat(F.lit("read "), "field_name")).cast("string")})
    e = Estate(spark, {"measures": measures, "bindings": made[1].withColumn("field_type", F.lit("measure")).unionByName(columns)})
    c = queries.Context.__new__(queries.Context)
    c.spark = spark
    c.e = c.s = e
    for found in (c.mstatus, Audit(e).measure_status):
        assert sorted((r.name, r.status) for r in found.collect()) == [("a", "direct"), ("b", "indirect"), ("d", "unused")]


def test_bodies_are_read_once_for_used_columns(spark):
    """The references of the bodies are written before they are joined: no join's plan reads a body again."""
    e = Estate(spark, {
        "measures": spark.createDataFrame([("m", "T", "a", "SUM(T[x]) + [y]", "", "", "")], SCHEMAS["measures"]),
        "columns": spark.createDataFrame([("m", "T", n) for n in "xyz"], "model_id string, table_name string, name string"),
    })
    used = spark.createDataFrame([("m", "T", "a", "direct")], "model_id string, table_name string, name string, status string")
    for mode, names in (("strict", ["x"]), ("compat", ["x", "y"])):
        found = usage.referenced_columns(e, used, mode)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.name for r in found.collect()) == names
