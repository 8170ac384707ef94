"""Functions over ETL bodies (``let ... in`` expressions): source inference and step classification.

Everything is a column expression: one balanced-group regex splits a body into its top-level statements, so commas in
strings, brackets and lambdas never cut a step, and no Python runs per row.  A regex nests to a fixed depth; bodies beyond it are split by a scan
over their tokens with a running depth, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions import patterns as P
from estatelens.functions.text import trimmed, undouble

GROUP = P.nested(r"(\[{", r")\]}")

_WORD = r"[A-Za-z_]\w*+"
_OTHER = r"[^A-Za-z_\"()\[\]{}]"
_BEFORE_LET = rf"(?:{P.CLOSED_STRING}|{GROUP}|(?!let\b){_WORD}|{_OTHER})*+"
_LET_ITEMS = rf"{P.CLOSED_STRING}|{GROUP}|(?!(?:let|in)\b){_WORD}|{_OTHER}"
_LET_BODY = rf"(?:{_LET_ITEMS})*+"
for _ in range(4):
    _LET_BODY = rf"(?:{_LET_ITEMS}|let\b{_LET_BODY}in\b)*+"
LET_BLOCK = rf"^{_BEFORE_LET}let\b({_LET_BODY})in\b"
STATEMENT = rf'(?:{P.CLOSED_STRING}|{GROUP}|[^,"()\[\]{{}}]++)++'
TOKEN = rf'{P.CLOSED_STRING}|{_WORD}|[()\[\]{{}},"]|[^A-Za-z_,"()\[\]{{}}]++'
COMMENTS_KEEP_STRINGS = rf"({P.CLOSED_STRING})|{P.BLOCK_COMMENT}|{P.LINE_COMMENT}"

ARGUMENT = rf'{P.CLOSED_STRING}|[(),"]|[^(),"]++'
LISTED = rf"{P.CLOSED_STRING}|[{{}}]"
QUERY_OPTION = r'\bQuery\s*=\s*"([^"]*+(?:""[^"]*+)*+)"'


def source_type(body: Column, lowered: Column) -> Column:
    """Label of the first known keyword in ``body``; pass its lowercase form so it is computed once."""
    chain = None
    for keyword, case_sensitive, label in P.SOURCE_KEYWORDS:
        hit = (body if case_sensitive else lowered).contains(keyword)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(P.SOURCE_UNKNOWN)


def source_location(body: Column) -> Column:
    return F.regexp_extract(body, '"([^"]+)"', 1)


def native_query(body: Column) -> Column:
    """SQL text handed to the source: second argument of the native call, else a ``Query="..."`` option."""
    at = F.instr(body, "Value.NativeQuery(")
    call = F.when(at > 0, _second_string(F.substring(body, at + len("Value.NativeQuery("), F.length(body)))).otherwise(F.lit(""))
    options = F.filter(F.regexp_extract_all(body, F.lit(QUERY_OPTION), F.lit(1)), lambda q: q.rlike("(?i)select|with|exec"))
    direct = trimmed(undouble(call))
    return F.when(direct != "", direct).otherwise(F.coalesce(trimmed(undouble(F.get(options, F.lit(0)))), F.lit("")))


def _second_string(rest: Column) -> Column:
    """The string, without its quotes, that is the second argument of a call whose opening bracket lies before ``rest``; brackets nest at any depth."""
    tokens = F.regexp_extract_all(rest, F.lit(ARGUMENT), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        comma = F.when(s["comma"] != 0, s["comma"]).when(depth == 0, -1).when((token == ",") & (depth == 1), s["at"] + 1).otherwise(0)
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), comma.alias("comma"))

    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("depth"), F.lit(0).alias("comma"))
    comma = F.aggregate(tokens, start, step, lambda s: s["comma"])
    first, second = F.get(tokens, comma), F.get(tokens, comma + 1)
    argument = F.when(trimmed(first) == "", second).otherwise(first)
    closed = (comma > 0) & argument.startswith('"') & (F.length(argument) > 1)
    return F.when(closed, F.substring(argument, 2, F.length(argument) - 2)).otherwise(F.lit(""))


def _first_list(text: Column) -> Column:
    """The strings of the first list in braces after a step's first bracket, lists in it included; all that follow where it isn't closed."""
    opened = F.greatest(F.instr(text, "("), F.lit(0))
    rest = F.substring(text, opened + 1, F.length(text))
    at = F.instr(rest, "{")
    tokens = F.when(at > 0, F.regexp_extract_all(F.substring(rest, at, F.length(rest)), F.lit(LISTED), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        ended = s["ended"] | (depth == 0)
        return F.struct((s["n"] + F.when(ended, 0).otherwise(1)).alias("n"), F.when(s["ended"], s["depth"]).otherwise(depth).alias("depth"), ended.alias("ended"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("ended"))
    n = F.aggregate(tokens, start, step, lambda s: s["n"])
    strings = F.filter(F.slice(tokens, F.lit(1), n), lambda t: t.startswith('"'))
    return F.transform(strings, lambda t: undouble(F.substring(t, 2, F.length(t) - 2)))


def _source(kind: Column, server: Column, database: Column, schema: Column, name: Column) -> Column:
    return F.struct(
        kind.alias("kind"), server.alias("server"), database.alias("database"), schema.alias("schema"), name.alias("name")
    )


def sql_source(body: Column) -> Column:
    def nav(first: int) -> Column:
        a, b = F.regexp_extract(body, P.NAV_SCHEMA_ITEM, first), F.regexp_extract(body, P.NAV_ITEM_SCHEMA, 3 - first)
        return F.when(a != "", a).otherwise(b)

    def group(n: int) -> Column:
        return F.regexp_extract(body, P.CONNECTOR_DATABASE, n)

    return F.when(body.rlike(P.CONNECTOR_DATABASE), _source(group(1), group(2), group(3), nav(1), nav(2)))


def bigquery_source(body: Column) -> Column:
    def step(ref: Column) -> Column:
        return F.struct(
            F.regexp_extract(ref, P.NAV_NAME_PARTS, 1).alias("name"), F.regexp_extract(ref, P.NAV_NAME_PARTS, 2).alias("kind")
        )

    steps = F.transform(F.regexp_extract_all(body, F.lit(P.NAV_NAME), F.lit(0)), step)

    def last(kind: str) -> Column:
        return F.coalesce(F.element_at(F.filter(steps, lambda s: s["kind"] == kind), -1)["name"], F.lit(""))

    argument = F.regexp_extract(body, P.BIGQUERY_PROJECT, 1)
    first_other = F.get(F.filter(steps, lambda s: ~s["kind"].isin("Schema", "Table")), F.lit(0))["name"]
    project = F.when(argument != "", argument).otherwise(F.coalesce(first_other, F.lit("")))
    source = _source(F.lit("BigQuery"), F.lit("GoogleBigQuery"), project, last("Schema"), last("Table"))
    return F.when(body.rlike(P.BIGQUERY), source)


def file_source(body: Column) -> Column:
    def at(kind: Column, path: Column) -> Column:
        slashed = F.replace(path, F.lit("\\"), F.lit("/"))
        folder = F.when(slashed.contains("/"), F.regexp_extract(slashed, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(F.lit(""))
        return _source(kind, F.lit(""), F.lit(""), folder, F.substring_index(slashed, "/", -1))

    tool = F.regexp_extract(body, P.FILE_DOCUMENT, 1)
    kind = F.coalesce(*[F.when(tool == name, label) for name, label in P.FILE_KINDS.items()])
    document = F.when(body.rlike(P.FILE_DOCUMENT), at(kind, F.regexp_extract(body, P.FILE_DOCUMENT, 2)))
    bare = F.when(body.rlike(P.FILE_CONTENTS), at(F.lit("File"), F.regexp_extract(body, P.FILE_CONTENTS, 1)))
    return F.coalesce(document, bare)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, P.URL_PARTS, 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, P.URL_PARTS, 2)
    return F.when(path == "", F.lit("/")).otherwise(path)


def sharepoint_source(body: Column) -> Column:
    url, none = F.regexp_extract(body, P.SHAREPOINT, 1), F.lit("")
    good = _source(F.lit("SharePoint"), url_host(url), none, url_path(url), none)
    malformed = _source(F.lit("SharePoint"), none, none, none, url)
    return F.when(body.rlike(P.SHAREPOINT), F.when(url.rlike(P.URL_PARTS), good).otherwise(malformed))


def web_source(body: Column) -> Column:
    url, none = F.regexp_extract(body, P.WEB_CONTENTS, 1), F.lit("")
    good = _source(F.lit("Web"), url_host(url), none, none, url_path(url))
    malformed = _source(F.lit("Web"), none, none, none, url)
    return F.when(body.rlike(P.WEB_CONTENTS), F.when(url.rlike(P.URL_PARTS), good).otherwise(malformed))


def physical_source(body: Column) -> Column:
    """External coordinates of a body, first matching shape wins; null when none is recognised."""
    return F.coalesce(sql_source(body), bigquery_source(body), file_source(body), sharepoint_source(body), web_source(body))


def source_key(source: Column) -> Column:
    return F.concat_ws("|", source["kind"], source["server"], source["database"], source["schema"], source["name"])


def statements(body: Column) -> Column:
    """Top-level statements of the outer ``let`` block as array<struct<name, text>>, comments dropped."""
    clean = F.regexp_replace(body, COMMENTS_KEEP_STRINGS, "$1")
    block = F.regexp_extract(clean, LET_BLOCK, 1)
    pieces = F.when(block != "", F.regexp_extract_all(block, F.lit(STATEMENT), F.lit(0))).otherwise(_scanned(clean))

    def named(statement: Column) -> Column:
        raw = trimmed(F.substring_index(statement, "=", 1))
        quoted = F.regexp_extract(raw, r'(?s)^#"(.*)"\z', 1)
        name = F.when(raw.rlike(r'(?s)^#".*"\z'), undouble(quoted)).otherwise(raw)
        text = trimmed(F.substring(statement, F.instr(statement, "=") + 1, F.length(statement)))
        return F.struct(name.alias("name"), text.alias("text"))

    found = F.filter(pieces, lambda s: s.contains("="))
    return F.filter(F.transform(found, named), lambda s: (s["name"] != "") & (s["text"] != ""))


def _scanned(clean: Column) -> Column:
    """Pieces between the top-level commas of the outer ``let`` block, at any depth of brackets and of ``let`` in ``let``; none if it isn't closed."""
    none = F.array().cast("array<string>")

    def state(phase: Column, depth: Column, lets: Column, piece: Column, pieces: Column) -> Column:
        return F.struct(phase.alias("phase"), depth.alias("depth"), lets.alias("lets"), piece.alias("piece"), pieces.alias("pieces"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)
        top, inside = depth == 0, s["phase"] == 1
        ends = inside & top & (token == "in") & (s["lets"] == 0)
        cuts = ends | (inside & top & (token == ","))
        phase = (
            F.when(s["phase"] > 1, s["phase"]).when((depth < 0) | (token == '"'), 3)
            .when((s["phase"] == 0) & top & (token == "let"), 1).when(ends, 2).otherwise(s["phase"])
        )
        lets = s["lets"] + F.when(inside & top & (token == "let"), 1).when(inside & top & (token == "in"), -1).otherwise(0)
        piece = F.when(cuts | ~inside, "").otherwise(F.concat(s["piece"], token))
        return state(phase, depth, lets, piece, F.when(cuts, F.concat(s["pieces"], F.array(s["piece"]))).otherwise(s["pieces"]))

    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(""), none)
    done = F.aggregate(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), start, step, lambda s: F.when(s["phase"] == 2, s["pieces"]).otherwise(none))
    return F.when(clean.rlike(r"(?s)let\b.*in\b"), done).otherwise(none)


def step_kind(text: Column) -> Column:
    chain = (
        F.when(text.rlike(P.STEP_NAVIGATION), "navigation")
        .when(text.rlike(P.STEP_LITERAL), "source")
        .when(text.rlike(P.STEP_CONNECTOR), "source")
    )
    for function, kind in P.STEP_FUNCTIONS:
        chain = chain.when(_calls(text, function), kind)
    return chain.otherwise("custom")


def _calls(text: Column, function: str) -> Column:
    escaped = function.replace(".", r"\.")
    return text.contains(function + "(") & text.rlike(rf"(?:^|[^A-Za-z0-9._]){escaped}\(")


def step_function(text: Column) -> Column:
    chain = (
        F.when(text.rlike(P.STEP_NAVIGATION), "")
        .when(text.rlike(P.STEP_LITERAL), F.regexp_extract(text, P.STEP_LITERAL, 1))
        .when(text.rlike(P.STEP_CONNECTOR), F.regexp_extract(text, P.STEP_FIRST_CALL, 1))
    )
    for function, _ in P.STEP_FUNCTIONS:
        chain = chain.when(_calls(text, function), function)
    return chain.otherwise(F.regexp_extract(text, P.STEP_FIRST_CALL, 1))


def step_summary(text: Column, kind: Column) -> Column:
    """One line about a step, by kind; empty when nothing short can be said."""
    none = F.lit("")

    def wrapped(prefix: str, pattern: str, suffix: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", F.concat(F.lit(prefix), found, F.lit(suffix))).otherwise(none)

    names = _first_list(text)
    count = F.size(names)
    projected = F.when(
        count > 4, F.concat(F.array_join(F.slice(names, 1, 4), ", "), F.lit(" (+"), (count - 4).cast("string"), F.lit(" more)"))
    ).otherwise(F.array_join(names, ", "))

    pairs = F.size(F.regexp_extract_all(text, F.lit(P.STEP_PAIR), F.lit(0)))
    paired = F.when(pairs > 0, F.concat(pairs.cast("string"), F.when(pairs == 1, F.lit(" column")).otherwise(F.lit(" columns")))).otherwise(none)

    words = F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z0-9_]*\b"), F.lit(0))
    n = F.size(words)
    joined = F.array_join(F.slice(words, 1, 2), " ⋈ ")
    third = F.when(n > 2, F.concat(F.lit(" + "), F.get(words, F.lit(2)))).otherwise(none)
    rest = F.when(n > 3, F.concat(F.lit(" + "), (n - 3).cast("string"), F.lit(" more"))).otherwise(none)
    united = F.when(n < 2, none).otherwise(F.concat(F.get(words, F.lit(1)), third, rest))

    return (
        F.when(kind == "source", F.regexp_extract(text, '"([^"]+)"', 1))
        .when(kind == "navigation", F.regexp_extract(text, r'(?:Schema|Item|Name)\s*=\s*"([^"]+)"', 1))
        .when(kind == "filter", wrapped("where [", r"each\s*\[([^\]]+)\]", "] …"))
        .when(kind == "projection", projected)
        .when(kind.isin("rename", "typeChange"), paired)
        .when(kind == "addColumn", wrapped("+[", r'\(\s*[^,]+,\s*"([^"]+)"', "]"))
        .when(kind == "join", joined)
        .when(kind == "union", united)
        .when(kind == "expand", wrapped("expand [", r',\s*"([^"]+)"\s*,\s*\{', "]"))
        .otherwise(none)
    )
