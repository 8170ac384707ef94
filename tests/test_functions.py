"""Text and ETL functions on inline rows."""

import pytest
from pyspark.sql import functions as F

from estatelens.functions import etl, text

col = F.col


@pytest.fixture
def each(spark):
    """Value of an expression over column ``t``, per text."""

    def get(expression, *texts):
        numbered = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
        return [r["v"] for r in numbered.select("n", expression.alias("v")).orderBy("n").collect()]

    return get


def test_references(each):
    bodies = [
        "SUMX(Orders, Orders[Qty] * 'Price List'[Unit Price])", "[Margin] / [Margin]", 'IF([On], "Orders[Nope] or [Nope]", 0) // Orders[Old]',
        "A[x] /* B[y] */ + [m1] + \"say \"\"[no]\"\"\" + [m2]", 'A[x] + "open [z]', "", "1 /* open A[b]",
    ]
    clean = text.strip_comments_and_strings(col("t"))
    found = each(text.qualified_refs(clean), *bodies)
    assert [[tuple(r) for r in rs] for rs in found] == [
        [("Orders", "Qty"), ("Price List", "Unit Price")], [], [], [("A", "x")], [("A", "x")], [], []]
    assert each(text.bare_refs(clean), *bodies) == [[], ["Margin"], ["On"], ["m1", "m2"], [], [], []]
    assert each(text.bracket_tokens(col("t")), bodies[2]) == [["On", "Nope", "Old"]]


def test_long_texts_do_not_overflow(each):
    big = "/*" + "x * " * 60_000 + "*/ [A]" + '"' + 'q""' * 60_000 + '" + [B]' + "// z" * 20_000
    assert each(text.bare_refs(text.strip_comments_and_strings(col("t"))), big) == [["A", "B"]]
    steps = "let\n" + ",\n".join(f'    S{n} = Table.SelectRows(S, each [c] = "a,b({n}")' for n in range(3000)) + "\nin S"
    assert len(each(etl.statements(col("t")), steps)[0]) == 3000


def test_proxy_parts(each):
    body = 'EXTERNALMEASURE( "Net ""A""" , double, "DirectQuery to AS - Group Model")'
    assert each(F.concat_ws("|", text.external_name(col("t")), text.external_type(col("t")), text.external_model(col("t"))), body) == ['Net "A"|DOUBLE|Group Model']
    assert each(text.is_external(col("t")), body, "SUM(A[b])") == [True, False]


def test_body_functions(each):
    assert each(text.dedent(col("t")), "\t\ta\n\t\t\tb\n\n\t\tc", "a\n  b", "   \n  x") == ["a\n\tb\n\nc", "a\n  b", " \nx"]
    assert each(text.capped_body(col("t"), 5), "  abc ", "abcdefgh") == ["abc", "abcde\n\n… (truncated — 3 more chars)"]
    assert each(text.non_blank_lines(col("t")), "a\n\n \t\nb", "") == [2, 0]
    assert each(text.normalized_body(col("t")), " a \n\tb  c ") == ["a b c"]
    assert [[tuple(p) for p in ps] for ps in each(text.parameters(col("t")), "a : INT, b", "", " x:Y ")] == [[("a", "INT"), ("b", "")], [], [("x", "Y")]]


def test_names(each):
    headings = ["3. Sources & Sinks", "Rate (net)", "Cost: a/b", "  Two   gaps ", "fact_sales", "It's `x`?!"]
    assert each(text.wiki_slug(col("t")), *headings) == ["3-sources-sinks", "rate-net", "cost-ab", "two-gaps", "fact_sales", "its-x"]
    assert each(text.github_slug(col("t")), "A  b.c -- D") == ["a-bc-d"]
    assert each(text.letter_bucket(col("t")), " alpha", "9", "", "émile") == ["A", "#", "#", "#"]
    assert each(text.truncated(col("t"), 2, 3), "abc", "abcd") == ["abc", "ab…"]
    assert each(text.csv_field(col("t")), 'a,"b"', "plain", "x\ny") == ['"a,""b"""', "plain", '"x\ny"']


SQL = 'let\n S = Sql.Database("h1", "d1"),\n T = S{[Schema="s1",Item="t1"]}[Data]\nin T'
SOURCES = {
    SQL: ("Sql", "h1", "d1", "s1", "t1"),
    'S = Sql.Database("h"), t = S{[Item="i",Schema="s"]}[Data]': ("Sql", "h", "", "s", "i"),
    'S = Sql.Database("h","d",[Query="SELECT 1"])': ("Sql", "h", "d", "", ""),
    'S = GoogleBigQuery.Database(), p = S{[Name="pr"]}[Data], d = p{[Name="ds",Kind="Schema"]}[Data], t = d{[Name="ta",Kind="Table"]}[Data]': ("BigQuery", "GoogleBigQuery", "pr", "ds", "ta"),
    'S = Parquet.Document(File.Contents("D:\\x\\y\\z.parquet"))': ("Parquet", "", "", "D:/x/y", "z.parquet"),
    'S = Excel.Workbook(File.Contents("./b.xlsx"), null, true)': ("Excel", "", "", ".", "b.xlsx"),
    'S = File.Contents("raw.bin")': ("File", "", "", "", "raw.bin"),
    'S = Json.Document(Web.Contents("https://Api.example.org:8080/v2/x?y=1"))': ("Web", "api.example.org", "", "", "/v2/x"),
    'S = Web.Contents("not a url")': ("Web", "", "", "", "not a url"),
    'S = SharePoint.Files("https://o.example.org/sites/f", [ApiVersion = 15])': ("SharePoint", "o.example.org", "", "/sites/f", ""),
    "let x = 1 in x": None, 'Table.FromRows({{"a"}})': None, "": None,
}


def test_physical_source(each):
    found = each(etl.physical_source(col("t")), *SOURCES)
    assert [tuple(s) if s else None for s in found] == list(SOURCES.values())


def test_native_query(each):
    bodies = {
        'let Q = Value.NativeQuery(S, "SELECT ""c d"" FROM t", null) in Q': 'SELECT "c d" FROM t',
        'Value.NativeQuery(Sql.Database("h", "d", [T=#duration(0,0,1,0)]), "SELECT 2")': "SELECT 2",
        'Value.NativeQuery(S, "WITH a AS (\n  SELECT 1\n) SELECT * FROM a")': "WITH a AS (\n  SELECT 1\n) SELECT * FROM a",
        'S = Sql.Database("h", "d", [Query="exec p"])': "exec p", 'Csv.Document(S, [Query="file.csv"])': "", SQL: "", "": "",
    }
    assert each(etl.native_query(col("t")), *bodies) == list(bodies.values())


STEPS = {
    SQL: [("S", "source", "Sql.Database", "h1"), ("T", "navigation", "", "s1")],
    'let\n    #"Kept rows" = Table.SelectRows(X, each [Day] > 1),\n    R = Table.RenameColumns(#"Kept rows", {{"a", "b"}, {"c", "d"}}),\n    Y = Table.TransformColumnTypes(R, {{"b", type text}})\nin Y': [
        ("Kept rows", "filter", "Table.SelectRows", "where [Day] …"), ("R", "rename", "Table.RenameColumns", "2 columns"), ("Y", "typeChange", "Table.TransformColumnTypes", "1 column")],
    'let A = Table.AddColumn(B, "Size", each let v = [n] in if v > 0 then "a, b" else "c"), C = Table.SelectColumns(A, {"p", "q"}) in C': [
        ("A", "addColumn", "Table.AddColumn", "+[Size]"), ("C", "projection", "Table.SelectColumns", "p, q")],
    'let // gone = Sql.Database("x"),\n S = Sql.Database("a,b", "d"), /* , f = 1 */ U = Table.Combine({S, T, V}) in U': [
        ("S", "source", "Sql.Database", "a,b"), ("U", "union", "Table.Combine", "Combine + S + 2 more")],
    "let X = Our.Own.Function(1) in X": [("X", "custom", "Our.Own.Function", "")],
    'let T = #table({"c"}, {{"x"}}) in T': [("T", "source", "#table", "c")],
    'let E = Table.ExpandTableColumn(J, "B", {"v"}, {"B.v"}) in E': [("E", "expand", "Table.ExpandTableColumn", "expand [B]")],
    "42": [], "": [], 'Sql.Database("s")': [],
}


def test_steps(each):
    steps = F.transform(
        etl.statements(col("t")),
        lambda s: F.struct(s["name"], etl.step_kind(s["text"]), etl.step_function(s["text"]), etl.step_summary(s["text"], etl.step_kind(s["text"]))),
    )
    assert [[tuple(s) for s in found] for found in each(steps, *STEPS)] == list(STEPS.values())


def test_steps_at_any_depth(each):
    deep = "let A = " + "(" * 100 + '"x, y"' + ")" * 100 + ", B = [a = {1, 2}] in B"
    nested = "let A = " + "let x = 1, y = 2 in " * 10 + "x, B = 2 in B"
    flat = 'let A = let x = 1, y = 2 in x, B = "in, let" in B'
    names = F.transform(etl.statements(col("t")), lambda s: s["name"])
    found = each(names, deep, nested, flat, "let A = (1, B = 2", "let A = " + "(" * 30 + ", B = 2 in A", "x in y")
    assert found == [["A", "B"], ["A", "y", *(["y"] * 9), "B"], ["A", "y", "B"], [], [], []]


def test_scan_and_pattern_agree(each):
    scanned = F.filter(etl._scanned(F.regexp_replace(col("t"), etl.COMMENTS_KEEP_STRINGS, "$1")), lambda s: s.contains("="))
    block = F.regexp_extract(F.regexp_replace(col("t"), etl.COMMENTS_KEEP_STRINGS, "$1"), etl.LET_BLOCK, 1)
    matched = F.filter(F.regexp_extract_all(block, F.lit(etl.STATEMENT), F.lit(0)), lambda s: s.contains("="))
    assert each(scanned, *STEPS) == each(matched, *STEPS)


def test_source_types(each):
    bodies = ['X = SQL.DATABASE("a")', 'Binary.FromText("x")', "binary.fromtext(", "Databricks.Catalogs()", 'Table.FromRows(Json.Document("x"))', "let a = 1 in a"]
    assert each(etl.source_type(col("t"), F.lower("t")), *bodies) == ["SQL Server", "Inline (encoded)", "Unknown / M", "Databricks", "Inline data", "Unknown / M"]
