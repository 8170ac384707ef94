"""Project files to rows: text blocks, JSON models, reports, roots and pairs."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from estatelens import Estate
from estatelens.operators import usage
from estatelens.sinks import tables
from estatelens.sources import bim, blocks, files, project, report

SALES = """/// Sold goods
/// by day
table 'Sales Data'
\tlineageTag: 1-2

\t/// All of it
\tmeasure 'Total = Sum' = SUM('Sales Data'[Amount])
\t\tformatString: "#,0"
\t\tdisplayFolder: Main

\tmeasure Long =
\t\t\tVAR x = 1
\t\t\tRETURN
\t\t\t\tx + [Total = Sum]
\t\tformatString: 0
\t\tannotation PBI = 1

\t/// Money
\tcolumn Amount
\t\tdataType: decimal
\t\tisHidden: true
\t\tsummarizeBy: sum

\tcolumn 'Net Amount' = [Amount] - 1
\t\tisKey: true

\thierarchy 'By Date'
\t\tlineageTag: 3

\t\t/// Calendar year
\t\tlevel Year
\t\t\tcolumn: Year
\t\tlevel 'Month Name'
\t\t\tcolumn: 'Month Name'

\tpartition 'Sales Data' = m
\t\tmode: directQuery
\t\tsource =
\t\t\tlet
\t\t\t    Source = Sql.Database("s", "d")
\t\t\tin
\t\t\t    Source

\tannotation Done = 1
"""
REMOTE = "table Remote\n\tpartition Remote = entity\n\t\tmode: directQuery\n\t\tsource\n\t\t\tentityName: Remote\n\t\t\texpressionSource: 'DirectQuery to AS - X'\n"
PARAM = "table Picker\n\tcolumn Picker\n\t\tdataType: string\n\t\textendedProperty ParameterMetadata =\n\t\t\t\t{ \"version\": 3 }\n"
GROUP = """table Time
\tcalculationGroup
\t\tprecedence: 0

\t\t/// As is
\t\tcalculationItem Current = SELECTEDMEASURE()

\t\tcalculationItem 'Year to date' =
\t\t\t\tCALCULATE(
\t\t\t\t\tSELECTEDMEASURE())
\t\tformatStringExpression: "0"

\tcolumn Name
\t\tdataType: string
"""
RELATIONSHIPS = """relationship r1
\tfromColumn: 'Sales.Data'.'Date Key'
\ttoColumn: Date.Key
\tisActive: false
\tcrossFilteringBehavior: bothDirections

relationship r2
\tfromCardinality: one
\ttoCardinality: weird
\tfromColumn: A.b
\ttoColumn: C.d
"""
EXPRESSIONS = """/// Where it lives
expression Server = "db.example.com" meta [IsParameterQuery=true, Type="Text"]
\tlineageTag: 4

expression 'DirectQuery to AS - X' =
\t\tlet
\t\t    Source = AnalysisServices.Database("c", "x")
\t\tin
\t\t    Source
\tlineageTag: 5
\tannotation A = 1
"""
FUNCTIONS = """/// Adds tax
function 'Add.Tax' = ```
\t\t(amount : NUMERIC,
\t\t rate) =>
\t\tamount * rate
\t\t```
\tlineageTag: 6

function Twice = (x) => x * 2
"""
MODEL = "/// About sales\nmodel Main\n\tculture: en-GB\n\tsourceQueryCulture: de-DE\n\tdiscourageImplicitMeasures\n\tvalueFilterBehavior: Coalesced\n"


def corpus(spark, texts, workspace="ws"):
    return spark.createDataFrame([(workspace, path, text) for path, text in texts.items()], "workspace string, path string, content string")


@pytest.fixture(scope="module")
def text_model(spark):
    base = "/ws/Main.SemanticModel/definition"
    return corpus(spark, {
        f"{base}/tables/a.tmdl": SALES.replace("\n", "\r\n"), f"{base}/tables/b.tmdl": REMOTE, f"{base}/tables/c.tmdl": PARAM, f"{base}/tables/d.tmdl": GROUP,
        f"{base}/relationships.tmdl": RELATIONSHIPS, f"{base}/expressions.tmdl": EXPRESSIONS, f"{base}/functions.tmdl": FUNCTIONS, f"{base}/model.tmdl": MODEL,
        f"{base}/database.tmdl": "database\n\tcompatibilityLevel: 1601\n", f"{base}/cultures/en-GB.tmdl": "", f"{base}/cultures/de-DE.tmdl": "",
    })


def test_text_tables_and_measures(text_model, rows):
    sections = blocks.table_sections(text_model)
    assert rows(blocks.tables(sections), "table_name", "description", "is_calc_group") == [
        ("Picker", "", False), ("Remote", "", False), ("Sales Data", "Sold goods by day", False), ("Time", "", True)]
    found = blocks.members(sections)
    assert rows(blocks.measures(found), "name", "body", "format_string", "description", "display_folder") == [
        ("Long", "VAR x = 1\nRETURN\nx + [Total = Sum]", "0", "", ""), ("Total = Sum", "SUM('Sales Data'[Amount])", "#,0", "All of it", "Main")]
    assert rows(blocks.columns(found), "table_name", "name", "data_type", "description", "is_key", "is_hidden", "is_calculated", "has_param_metadata", "summarize_by") == [
        ("Picker", "Picker", "string", "", False, False, False, True, ""), ("Sales Data", "Amount", "decimal", "Money", False, True, False, False, "sum"),
        ("Sales Data", "Net Amount", "string", "", True, False, True, False, ""), ("Time", "Name", "string", "", False, False, False, False, "")]


def test_text_groups_partitions_levels(text_model, rows):
    found = blocks.members(blocks.table_sections(text_model))
    assert rows(blocks.calc_items(found), "group_name", "precedence", "ordinal", "name", "body", "format_expr", "description") == [
        ("Time", 0, 0, "Current", "SELECTEDMEASURE()", "", "As is"), ("Time", 0, 1, "Year to date", "CALCULATE(\nSELECTEDMEASURE())", '"0"', "")]
    body = 'let\n\t\t\t    Source = Sql.Database("s", "d")\n\t\t\tin\n\t\t\t    Source'
    assert rows(blocks.partitions(found), "table_name", "name", "mode", "kind", "expression_source", "m_body") == [
        ("Remote", "Remote", "directQuery", "entity", "DirectQuery to AS - X", "entityName: Remote"), ("Sales Data", "Sales Data", "directQuery", "m", "", body)]
    assert rows(blocks.hierarchies(found), "hierarchy", "level_no", "level", "column_name", "description") == [
        ("By Date", 0, "Year", "Year", "Calendar year"), ("By Date", 1, "Month Name", "Month Name", "")]


def test_text_model_files(text_model, rows):
    assert rows(blocks.relationships(text_model), "from_table", "from_column", "to_table", "to_column", "is_active", "from_card", "to_card", "cross_filter") == [
        ("A", "b", "C", "d", True, "one", "one", "oneDirection"), ("Sales.Data", "Date Key", "Date", "Key", False, "many", "one", "bothDirections")]
    assert rows(blocks.expressions(text_model), "name", "kind", "value", "metadata", "description") == [
        ("DirectQuery to AS - X", "m", 'let\n\t\t    Source = AnalysisServices.Database("c", "x")\n\t\tin\n\t\t    Source', "", ""),
        ("Server", "parameter", '"db.example.com"', 'IsParameterQuery=true, Type="Text"', "Where it lives")]
    assert rows(blocks.functions(text_model), "name", "parameters", "body", "description") == [
        ("Add.Tax", "amount : NUMERIC, rate", "amount * rate", "Adds tax"), ("Twice", "x", "x * 2", "")]
    assert rows(blocks.models(text_model), "name", "description", "culture", "source_query_culture", "cultures", "compatibility_level", "discourage_implicit", "value_filter") == [
        ("Main", "About sales", "en-GB", "de-DE", ["de-DE", "en-GB"], 1601, True, "Coalesced")]


BIM = {
    "compatibilityLevel": 1550,
    "model": {
        "name": "J", "description": ["a", "b"], "cultures": [{"name": "fr"}, {"name": "de"}], "discourageImplicitMeasures": True,
        "tables": [
            {"name": "T", "description": "d", "partitions": [
                {"name": "p", "source": {"type": "m", "expression": ["let", "    Source = 1", "in", "    Source"]}},
                {"name": "e", "mode": "directQuery", "source": {"type": "entity", "expression": "Shared"}}],
             "hierarchies": [{"name": "H", "levels": [{"name": "L", "column": "c", "description": ["x"]}]}],
             "measures": [{"name": "M", "expression": ["1", "+ 1"], "formatString": "0"}, {"name": "N", "expression": "[M]"}],
             "columns": [{"name": "c", "isKey": True, "extendedProperties": [{"name": "ParameterMetadata", "value": {}}]},
                         {"name": "k", "type": "calculated", "dataType": "int64"}, {"name": "r", "type": "rowNumber"}]},
            {"name": "G", "calculationGroup": {"calculationItems": [{"name": "b", "ordinal": 2, "expression": "2"}, {"name": "a", "expression": ["1"], "formatStringDefinition": ["f"]}]}}],
        "relationships": [{"fromTable": "T", "fromColumn": "c", "toTable": "U", "toColumn": "d", "isActive": False, "fromCardinality": "One", "toCardinality": "x"}],
        "expressions": [{"name": "F", "kind": "m", "expression": "(a,  b) => a"}, {"name": "P", "kind": "m", "expression": "'v'"}, {"name": "Q", "kind": "m", "expression": ["let", "x"]}],
    },
}


def test_json_model(spark, rows):
    found = bim.parsed(corpus(spark, {"/ws/J.SemanticModel/model.bim": json.dumps(BIM), "/ws/J.SemanticModel/definition/model.bim": "{}"}))
    assert rows(bim.models(found), "name", "description", "cultures", "compatibility_level", "discourage_implicit") == [("J", "a\nb", ["de", "fr"], 1550, True)]
    assert rows(bim.measures(found), "table_name", "name", "body", "format_string") == [("T", "M", "1\n+ 1", "0"), ("T", "N", "[M]", "")]
    assert rows(bim.columns(found), "name", "data_type", "is_key", "is_calculated", "has_param_metadata") == [("c", "string", True, False, True), ("k", "int64", False, True, False)]
    assert rows(bim.partitions(found), "part_no", "name", "mode", "kind", "expression_source", "m_body") == [
        (0, "p", "m", "m", "", "let\n    Source = 1\nin\n    Source"), (1, "e", "directQuery", "entity", "Shared", "Shared")]
    assert rows(bim.hierarchies(found), "hierarchy", "level_no", "level", "column_name", "description") == [("H", 0, "L", "c", "x")]
    assert rows(bim.relationships(found), "from_table", "to_column", "is_active", "from_card", "to_card", "cross_filter") == [("T", "d", False, "one", "one", "oneDirection")]
    assert rows(bim.functions(found), "name", "parameters", "body") == [("F", "a, b", "a")]
    assert rows(bim.expressions(found), "name", "kind", "value") == [("P", "parameter", "'v'"), ("Q", "m", "let\nx")]
    assert rows(bim.calc_items(found), "group_name", "precedence", "ordinal", "name", "body", "format_expr") == [("G", 0, 1, "a", "1", "f"), ("G", 0, 2, "b", "2", "")]
    assert rows(bim.tables(found), "table_name", "is_calc_group") == [("G", True), ("T", False)]


def ref(kind, table, name):
    owner = {"Property": name, "Expression": {"SourceRef": {"Entity": table}}}
    if kind == "Aggregation":
        return {"Aggregation": {"Expression": {"Column": owner}, "Function": 0}}
    if kind == "HierarchyLevel":
        return {"HierarchyLevel": {"Level": name, "Expression": {"Hierarchy": {"Hierarchy": "H", "Expression": {"SourceRef": {"Entity": table}}}}}}
    return {kind: owner}


def report_files():
    base = "/ws/R.Report/definition/pages"
    visual = {
        "name": "v1", "position": {"x": 5, "y": 6.5, "z": 1, "width": 0},
        "visual": {
            "visualType": "barChart", "visualContainerObjects": {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'My title'"}}}}}]},
            "query": {"queryState": {"Y": {"projections": [{"field": ref("Measure", "T", "M")}, {"field": ref("Aggregation", "T", "a")}]},
                                     "Category": {"projections": [{"field": ref("HierarchyLevel", "D", "Year")}, {"nope": 1}]}}},
            "objects": {"dataPoint": [{"properties": {"fill": {"solid": {"color": {"expr": ref("Measure", "T", "Colour")}}}}}],
                        "labels": [{"properties": {"deep": [{"more": [{"expr": ref("Column", "T", "c")}]}], "lit": {"expr": {"Literal": {"Value": "1D"}}}}}]},
        },
        "filterConfig": {"filters": [{"field": ref("Column", "T", "f")}, {"type": "x"}]},
    }
    return {
        f"{base}/pages.json": json.dumps({"pageOrder": ["p2", "p1", "p3"]}),
        f"{base}/p1/page.json": json.dumps({"displayName": "One", "visibility": "HiddenInViewMode", "width": 800, "height": -1}),
        f"{base}/p2/page.json": json.dumps({"displayName": "", "width": "wide"}),
        f"{base}/p1/visuals/v1/visual.json": json.dumps(visual), f"{base}/p1/visuals/v2/visual.json": "{broken", f"{base}/p2/visuals/v3/visual.json": json.dumps({"visual": {}}),
        f"{base}/p9/visuals/v4/visual.json": json.dumps(visual),
    }


def test_report(spark, rows):
    corpus_files = corpus(spark, report_files())
    pages = report.page_rows(corpus_files)
    assert rows(pages, "page_no", "page_id", "name", "hidden", "width", "height", "visual_count") == [
        (0, "p2", "p2", False, 1280.0, 720.0, 1), (1, "p1", "One", True, 800.0, 720.0, 2), (2, "p3", "p3", False, 1280.0, 720.0, 0)]
    visuals = report.parsed_visuals(corpus_files)
    assert rows(report.on_listed_pages(report.visual_rows(visuals), pages), "visual_id", "visual_type", "title", "x", "y", "z", "width", "height") == [
        ("v1", "barChart", "My title", 5.0, 6.5, 1.0, 100.0, 60.0), ("v3", "unknown", "unknown", 0.0, 0.0, 0.0, 100.0, 60.0)]
    found = report.on_listed_pages(report.binding_rows(visuals), pages)
    assert rows(found, "role", "field_type", "table_name", "field_name") == [
        ("Category", "column", "D", "Year"), ("Filter", "column", "T", "f"), ("Y", "aggregation", "T", "a"), ("Y", "measure", "T", "M"),
        ("dataPoint", "measure", "T", "Colour"), ("labels", "column", "T", "c")]
    order = [r["role"] for r in found.orderBy("seq").collect()]
    assert order == ["Y", "Y", "Category", "Filter", "dataPoint", "labels"]


def pbir(path):
    return json.dumps({"version": "4.0", "datasetReference": {"byPath": {"path": path}}})


def test_roots_and_pairs(spark, rows):
    texts = {
        "/ws/a/One.Report/definition.pbir": pbir("../Other.semanticmodel"), "/ws/a/Other.SemanticModel/definition/model.tmdl": "",
        "/ws/a/Two.Report/definition.pbir": "{broken", "/ws/a/two.SemanticModel/model.bim": "{}", "/ws/b/Lost.Report/report.json": "{}",
        "/ws/c/deep/Three.Report/definition.pbir": pbir("..\\..\\nowhere\\Gone.SemanticModel"), "/ws/c/deep/ThreeMore.SemanticModel/model.bim": "{}",
        "/ws/c/deep/ThreeMuchMore.SemanticModel/model.bim": "{}", "/ws/d/Alone.SemanticModel/x.tmdl": "",
    }
    found = corpus(spark, texts)
    assert len(rows(files.roots(found), "kind", "root")) == 9
    assert rows(files.shallowest_report(found), "root") == [("/ws/a/One.Report",)]
    assert rows(files.pairs_by_name(found), "report", "model", "reason", "expected") == [
        ("/ws/a/One.Report", "/ws/a/Other.SemanticModel", "pbir", "Other.semanticmodel"), ("/ws/a/Two.Report", "/ws/a/two.SemanticModel", "prefix", "Two.SemanticModel"),
        ("/ws/b/Lost.Report", None, "mismatch", "Lost.SemanticModel"), ("/ws/c/deep/Three.Report", None, "mismatch", "Gone.SemanticModel")]
    best = dict(rows(files.reports_for_models(found), "model", "report"))
    assert best["/ws/a/Other.SemanticModel"] == "/ws/a/One.Report" and best["/ws/a/two.SemanticModel"] == "/ws/a/Two.Report" and best["/ws/d/Alone.SemanticModel"] is None
    assert rows(files.pairs_on_disk(found), "report", "model", "reason") == [
        ("/ws/a/One.Report", "/ws/a/Other.SemanticModel", "first"), ("/ws/a/Two.Report", "/ws/a/Other.SemanticModel", "first"),
        ("/ws/b/Lost.Report", None, "none"), ("/ws/c/deep/Three.Report", "/ws/c/deep/ThreeMore.SemanticModel", "prefix")]
    assert rows(files.default_pair(found), "report", "model") == [("/ws/b/Lost.Report", "/ws/d/Alone.SemanticModel")]
    modes = dict(rows(files.projects(found).groupBy("mode").agg(F.count(F.lit(1)).alias("n")), "mode", "n"))
    assert modes == {"full": 3, "report-only": 1, "model-only": 3}


@pytest.mark.parametrize("pointer, reason", [
    (pbir("../M.SemanticModel"), "pbir"), (json.dumps({"byPath": {"path": "..\\M.SemanticModel"}}), "pbir"), (json.dumps({"path": "M.SemanticModel"}), "pbir"),
    (pbir("../Missing.SemanticModel"), "exact"), ("{}", "exact"),
])
def test_pointer_shapes(spark, rows, pointer, reason):
    texts = {"/ws/M.Report/definition.pbir": pointer, "/ws/M.SemanticModel/model.bim": "{}", "/ws/A.SemanticModel/model.bim": "{}"}
    assert rows(files.pairs_on_disk(corpus(spark, texts)), "model", "reason") == [("/ws/M.SemanticModel", reason)]


def test_walk_and_whole_estate(spark, rows, tmp_path):
    texts = {**{k.replace("/ws/R.Report", "/ws/Main.Report"): v for k, v in report_files().items()}, "/ws/Main.SemanticModel/definition/tables/T.TMDL": "\n", "/ws/x/J.SemanticModel/model.bim": json.dumps(BIM)}
    texts["/ws/Main.SemanticModel/definition/tables/sales.tmdl"] = "table T\n\tmeasure M = 1\n\tmeasure Colour = [M]\n\tcolumn c\n\tcolumn f\n\tcolumn a\n"
    for skipped in ("/ws/.git/a.json", "/ws/node_modules/b.json", "/ws/.pbi/c.json", "/ws/readme.md"):
        texts[skipped] = "{}"
    for path, text in texts.items():
        target = tmp_path / path[1:]
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    found = files.read_corpus(spark, str(tmp_path))
    assert found.count() == len(texts) - 4
    assert {r["workspace"] for r in found.select("workspace").distinct().collect()} == {"ws"}
    assert rows(project.formats(found), "format") == [("bim",), ("tmdl",)]
    staged = tempfile.mkdtemp(prefix="estate-")
    whole = project.read_estate(spark, str(tmp_path), f"{staged}/corpus")
    # Each kind of file is parsed once: the tables read what was parsed, and of members only the word they ask for.
    for name in ("columns", "measures", "partitions", "hierarchies", "calc_items", "visuals", "bindings"):
        frame = getattr(whole, name)
        kind = "visuals" if name in ("visuals", "bindings") else "json-models"
        assert any(f"corpus-parsed/{kind}" in f for f in frame.inputFiles())
    assert any(f"{staged}/corpus-parsed/members/word=measure" in f for f in whole.measures.inputFiles())
    tables.write_tables(whole, f"{staged}/estate")
    estate = Estate.read(spark, f"{staged}/estate")
    status = usage.measure_status(estate)
    assert rows(status, "table_name", "name", "status") == [("T", "Colour", "direct"), ("T", "M", "direct"), ("T", "M", "unused"), ("T", "N", "unused")]
    assert rows(usage.column_status(estate, status).where("model_id like '%Main.Report'"), "name", "status") == [("a", "direct"), ("c", "direct"), ("f", "direct")]


def test_walk_reads_every_name(spark, rows, tmp_path):
    names = ["A+B.SemanticModel/definition/tables/_Measures.tmdl", "A+B.SemanticModel/definition/tables/Margin %.tmdl", "A+B.SemanticModel/_x/a b.json", "A B.SemanticModel/model.bim", "A+B.Report/definition.pbir", "é%20ü/empty.json"]
    for n, name in enumerate(names):
        target = tmp_path / "ws" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("" if name.endswith("empty.json") else f"text {n}")
    for skipped in (".vscode/a.json", ".git/b.json", "picture.png"):
        (tmp_path / "ws" / skipped).parent.mkdir(exist_ok=True)
        (tmp_path / "ws" / skipped).write_text("{}")
    (tmp_path / "ws" / "gone.json").symlink_to(tmp_path / "nowhere.json")
    found = files.read_corpus(spark, str(tmp_path))
    assert rows(found, "path") == sorted(((f"{tmp_path}/ws/{n}",) for n in names), key=str)
    assert rows(found.where("path like '%empty.json'"), "content") == [("",)]
    assert {r.workspace for r in found.collect()} == {"ws"}
    assert rows(files.pairs_by_name(found), "report", "model") == [(f"{tmp_path}/ws/A+B.Report", f"{tmp_path}/ws/A+B.SemanticModel")]
    assert files.unreadable(spark, str(tmp_path / "missing")).count() == 1
