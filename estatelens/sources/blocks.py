"""Models stored as indented text blocks (``*.tmdl``).

A file is one row, its blocks are cut out with one regular expression per level and exploded: every step is narrow, so
reading a corpus needs no shuffle at all, whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import patterns as P
from estatelens.functions.text import non_empty, trimmed
from estatelens.sources.bim import LITERAL, PLAIN_LITERAL, one_of
from estatelens.sources.files import at, path_part

# Property words that end an expression, default order of calculation groups
PROPERTIES = [
    "formatString:", "lineageTag:", "summarizeBy:", "dataType:", "sourceColumn:", "displayFolder:", "description:", "isHidden:", "isKey:",
    "sortByColumn:", "dataCategory:", "isNameInferred:", "isDataTypeInferred:", "annotation ", "changedProperty ", "extendedProperty ",
]
DEFAULT_PRECEDENCE = 10

_REST = r"[^\n]*+"
_BLANK = r"[ \t]*+(?=\n|\z)"


def _block(depth: int, head: str) -> str:
    """Doc lines, a head at ``depth`` tabs, and every deeper or blank line after it (captures: docs, head, body)."""
    tabs = "\\t" * depth
    return rf"(?<![^\n])((?:{tabs}///{_REST}\n)*+){tabs}({head}{_REST})((?:\n(?:{tabs}\t{_REST}|{_BLANK}))*+)"


MEMBER = _block(1, r"(?=[^\t/\n])")
LEVEL = _block(2, r"level[ \t]")
ITEM = _block(2, r"calculationItem[ \t]").replace(r"\t\t\t[^\n]*+|", r"\t\t\t[^\n]*+|\t\tformatStringExpression:[^\n]*+|")
SECTION = rf"(?<![^\n])((?:///{_REST}\n)*+)(table[ \t]{_REST})((?:\n(?!///|table[ \t]){_REST})*+)"
RELATIONSHIP = rf"(?<![^\n])()[ \t]*+(relationship {_REST})((?:\n(?![ \t]*+relationship ){_REST})*+)"


def _named(word: str) -> str:
    """A top-level declaration with its docs, up to the next doc line or declaration."""
    return rf"(?<![^\n])((?:[ \t]*+///{_REST}\n|{_BLANK}\n)*+)[ \t]*+({word}[ \t]{_REST})((?:\n(?![ \t]*+(?:///|{word}[ \t])){_REST})*+)"


def _blocks(text: Column, pattern: str) -> Column:
    """array<struct<docs, head, body>>"""

    def parts(block: Column) -> Column:
        docs = F.transform(F.filter(F.split(F.regexp_extract(block, pattern, 1), "\n"), non_empty), lambda d: F.regexp_replace(trimmed(d), r"^///\s*", ""))
        return F.struct(
            F.array_join(docs, " ").alias("docs"), trimmed(F.regexp_extract(block, pattern, 2)).alias("head"), F.regexp_extract(block, pattern, 3).alias("body")
        )

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts)


def _file(files: DataFrame, place: str) -> DataFrame:
    text = F.regexp_replace("content", "\r\n?", "\n").alias("text")
    return at(files, place).select(path_part(place).alias("root"), "path", text)


def unquoted(name: Column) -> Column:
    return F.regexp_replace(trimmed(name), r"^'(.*)'$", "$1")


def unwrapped(value: Column) -> Column:
    """A property value without the quotes around it."""
    return F.regexp_replace(trimmed(value), r"""^['"]|['"]$""", "")


def prop(body: Column, name: str) -> Column:
    """Value of the first ``name:`` line; empty when there is none."""
    return trimmed(F.regexp_extract(body, rf"(?m)^\t{{2,}}{name}:(.*)$", 1))


def _after_word(head: Column) -> Column:
    return trimmed(F.regexp_extract(head, r"(?s)^\w+\s+(.*)$", 1))


DECLARED = r"(?s)^('[^']*+(?:''[^']*+)*+'\s*+|[^=]*+)(?:=(.*))?$"


def declared_name(head: Column) -> Column:
    """Name of ``word 'Name' = rest``; an equals sign inside the quotes belongs to the name."""
    return unquoted(F.regexp_extract(_after_word(head), DECLARED, 1))


def declared_rest(head: Column) -> Column:
    return trimmed(F.regexp_extract(_after_word(head), DECLARED, 2))


def deeper_lines(body: Column, tabs: int) -> Column:
    return F.filter(F.split(body, "\n"), lambda line: line.rlike(rf"^\t{{{tabs},}}[^\t]"))


def table_sections(files: DataFrame) -> DataFrame:
    """``(root, table_name, description, text)`` per table."""
    found = _file(files, "table").select("root", F.explode(_blocks(F.col("text"), SECTION)).alias("_s"))
    return found.select("root", unquoted(_after_word(F.col("_s.head"))).alias("table_name"), F.col("_s.docs").alias("description"), F.col("_s.body").alias("text"))


def members(sections: DataFrame) -> DataFrame:
    """Members of the tables in order: ``(root, table_name, word, docs, head, body, at)``."""
    found = sections.select("root", "table_name", F.posexplode(_blocks(F.col("text"), MEMBER)).alias("at", "_m"))
    return found.select("root", "table_name", "at", F.regexp_extract("_m.head", r"^(\w+)", 1).alias("word"), "_m.*")


def tables(sections: DataFrame) -> DataFrame:
    group = F.col("text").rlike(r"(?m)^\tcalculationGroup")
    return sections.select("root", "table_name", "description", group.alias("is_calc_group"))


def described(docs: Column, body: Column) -> Column:
    return F.when(docs != "", docs).otherwise(unwrapped(prop(body, "description")))


def measures(found: DataFrame) -> DataFrame:
    body, first = F.col("body"), declared_rest(F.col("head"))
    stops = "|".join(PROPERTIES)
    before = F.regexp_extract(body, rf"^((?:\n(?!\t\t\t*+(?:{stops})){_REST})*+)", 1)
    more = F.transform(deeper_lines(before, 3), trimmed)
    return found.where((F.col("word") == "measure") & F.col("head").contains("=")).select(
        "root", "table_name", declared_name(F.col("head")).alias("name"), trimmed(F.array_join(F.concat(F.array(first), more), "\n")).alias("body"),
        unwrapped(prop(body, "formatString")).alias("format_string"), described(F.col("docs"), body).alias("description"),
        unwrapped(prop(body, "displayFolder")).alias("display_folder"),
    )


def columns(found: DataFrame) -> DataFrame:
    body = F.col("body")

    def true(name: str) -> Column:
        return F.lower(prop(body, name)) == "true"

    kind = prop(body, "dataType")
    return found.where(F.col("word") == "column").select(
        "root", "table_name", declared_name(F.col("head")).alias("name"), F.when(kind == "", "string").otherwise(kind).alias("data_type"),
        described(F.col("docs"), body).alias("description"), true("isKey").alias("is_key"), true("isHidden").alias("is_hidden"),
        F.regexp_replace(_after_word(F.col("head")), "^'[^']*'", "").contains("=").alias("is_calculated"),
        body.rlike(r"(?m)^\t{2,}extendedProperty ParameterMetadata").alias("has_param_metadata"),
        *[unwrapped(prop(body, p)).alias(n) for p, n in (
            ("summarizeBy", "summarize_by"), ("sortByColumn", "sort_by_column"), ("dataCategory", "data_category"),
            ("formatString", "format_string"), ("displayFolder", "display_folder"),
        )],
    )


def calc_items(found: DataFrame) -> DataFrame:
    group = found.where(F.col("word") == "calculationGroup")
    precedence = F.coalesce(F.regexp_extract("body", r"(?m)^\t\tprecedence:\s*([0-9]+)", 1).try_cast("int"), F.lit(DEFAULT_PRECEDENCE))
    each = group.select("root", F.col("table_name").alias("group_name"), precedence.alias("precedence"), F.posexplode(_blocks(F.col("body"), ITEM)).alias("ordinal", "_i"))
    first = declared_rest(F.col("_i.head"))
    more = F.array_join(F.transform(deeper_lines(F.col("_i.body"), 3), trimmed), "\n")
    return each.select(
        "root", "group_name", "precedence", "ordinal", declared_name(F.col("_i.head")).alias("name"), F.when(first != "", first).otherwise(trimmed(more)).alias("body"),
        prop(F.col("_i.body"), "formatStringExpression").alias("format_expr"), F.col("_i.docs").alias("description"),
    )


def partitions(found: DataFrame) -> DataFrame:
    """Partitions with their own body; shared expressions are joined in later, by name."""
    named = r"""^partition\s+('[^']+'|"[^"]+"|[\w.-]+)\s*=\s*(\w+)"""
    source = rf"(?<![^\n])\t\tsource[ \t]*+(?:=({_REST}))?{_REST}((?:\n(?:\t\t\t{_REST}|{_BLANK}))*+)"
    inner = deeper_lines(F.regexp_extract("body", source, 2), 3)
    shared = r"""(?m)^\t{3,}expressionSource:\s*['"]?([^'"\n]+?)['"]?\s*$"""
    own = F.filter(inner, lambda line: ~line.rlike(r"^\t+expressionSource:"))
    first = trimmed(F.regexp_extract("body", source, 1))
    rows = F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), own)
    mode = trimmed(F.regexp_extract("body", r"(?m)^\t\tmode:(.*)$", 1))
    each = found.where(F.col("word") == "partition").select(
        "root", "table_name", "at", unwrapped(F.regexp_extract("head", named, 1)).alias("name"), F.when(mode == "", "import").otherwise(mode).alias("mode"),
        F.regexp_extract("head", named, 2).alias("kind"), F.regexp_extract(F.array_join(inner, "\n"), shared, 1).alias("expression_source"),
        trimmed(F.array_join(rows, "\n")).alias("m_body"),
    )
    # The position among all members orders the partitions of a table as well as a running number would.
    return each.withColumnRenamed("at", "part_no")


def hierarchies(found: DataFrame) -> DataFrame:
    each = found.where(F.col("word") == "hierarchy").select(
        "root", "table_name", unquoted(_after_word(F.col("head"))).alias("hierarchy"), F.posexplode(_blocks(F.col("body"), LEVEL)).alias("level_no", "_l")
    )
    column = unquoted(F.regexp_extract("_l.body", r"(?m)^\t\t\tcolumn:(.*)$", 1))
    return each.select("root", "table_name", "hierarchy", "level_no", unquoted(_after_word(F.col("_l.head"))).alias("level"), column.alias("column_name"), F.col("_l.docs").alias("description"))


def relationships(files: DataFrame) -> DataFrame:
    found = _file(files, "relationships").select("root", F.posexplode(_blocks(F.col("text"), RELATIONSHIP)).alias("rel_no", "_r"))
    body = F.col("_r.body")

    def value(name: str) -> Column:
        return trimmed(F.regexp_extract(body, rf"(?m)^\s*{name}:(.*)$", 1))

    end = r"^('[^']*'|[^.']+)\.(.*)$"  # a dot inside the quotes belongs to the table's name
    ends = [
        unquoted(F.regexp_extract(value(f"{side}Column"), end, group)).alias(f"{side}_{part}")
        for side in ("from", "to") for group, part in ((1, "table"), (2, "column"))
    ]
    active = value("isActive")
    return found.select(
        "root", F.col("rel_no").cast("long").alias("rel_no"), *ends, ((active == "") | active.contains("true")).alias("is_active"),
        one_of(F.lower(value("fromCardinality")), ["one", "many"], "many").alias("from_card"),
        one_of(F.lower(value("toCardinality")), ["one", "many"], "one").alias("to_card"),
        one_of(value("crossFilteringBehavior"), ["bothDirections", "oneDirection"], "oneDirection").alias("cross_filter"),
    ).where(F.col("from_table") != "")


def expressions(files: DataFrame) -> DataFrame:
    found = _file(files, "expressions").select("root", F.explode(_blocks(F.col("text"), _named("expression"))).alias("_e"))
    head = r"""(?s)^expression\s+('[^']+'|"[^"]+"|[\w.-]+)\s*=\s*(.*)$"""
    split = r"(?s)^(.*?) meta \[(.*)\][^\]]*$"
    rest = F.regexp_extract("_e.head", head, 2)
    with_meta = rest.rlike(split)
    inline = trimmed(F.when(with_meta, F.regexp_extract(rest, split, 1)).otherwise(rest))
    kept = F.filter(F.split("_e.body", "\n"), lambda x: non_empty(x) & ~x.rlike(r"^\s*(?:lineageTag:|annotation\b|changedProperty\b)"))
    literal = inline.rlike(LITERAL) | inline.rlike(PLAIN_LITERAL)
    return found.where(F.col("_e.head").rlike(head)).select(
        "root", unwrapped(F.regexp_extract("_e.head", head, 1)).alias("name"), F.when(literal, "parameter").otherwise("m").alias("kind"),
        F.when(inline != "", inline).otherwise(trimmed(F.array_join(kept, "\n"))).alias("value"),
        F.when(with_meta, trimmed(F.regexp_extract(rest, split, 2))).otherwise("").alias("metadata"), F.col("_e.docs").alias("description"),
    )


def functions(files: DataFrame) -> DataFrame:
    found = _file(files, "functions").select("root", F.explode(_blocks(F.col("text"), _named("function"))).alias("_f"))
    head = r"(?s)^function\s+(?:'([^']+)'|(\S+))\s*=\s*(```)?(.*)$"
    first = trimmed(F.regexp_extract("_f.head", head, 4))
    fenced = F.regexp_extract("_f.head", head, 3) != ""
    kept = F.transform(F.filter(F.split("_f.body", "\n"), lambda x: ~x.rlike(r"^\s*lineageTag:") & ~(fenced & x.rlike(r"^\s*```\s*$"))), trimmed)
    rows = F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))))
    text = trimmed(F.array_join(rows, "\n"))
    params = trimmed(F.regexp_replace(F.regexp_extract(text, P.FUNCTION_PARAMETERS, 1), r"\s+", " "))
    return found.where(F.col("_f.head").rlike(head)).select(
        "root", F.concat(F.regexp_extract("_f.head", head, 1), F.regexp_extract("_f.head", head, 2)).alias("name"), params.alias("parameters"),
        F.when(text.rlike(P.FUNCTION_PARAMETERS), trimmed(F.regexp_replace(text, P.FUNCTION_HEAD, ""))).otherwise(text).alias("body"), F.col("_f.docs").alias("description"),
    )


def models(files: DataFrame) -> DataFrame:
    """Model properties, database level and culture names, one row per model that has a model file."""
    text = F.col("text")
    head = rf"(?<![^\n])((?:///{_REST}\n)*+)(model[ \t]{_REST})((?:\n(?:\t{_REST}|{_BLANK}))*+)"
    block = F.get(_blocks(text, head), F.lit(0))
    body = block["body"]

    def value(name: str) -> Column:
        return F.coalesce(trimmed(F.regexp_extract(body, rf"(?m)^\t{name}:(.*)$", 1)), F.lit("")).alias

    level = _file(files, "database").select("root", F.regexp_extract("text", r"(?i)compatibilityLevel:\s*(\d+)", 1).try_cast("int").alias("compatibility_level"))
    cultures = at(files, "culture").groupBy(path_part("culture").alias("root")).agg(
        F.array_sort(F.collect_set(path_part("culture", 2))).alias("cultures")  # languages of one model: a handful
    )
    found = _file(files, "model").select(
        "root", F.coalesce(_after_word(block["head"]), F.lit("")).alias("name"), F.coalesce(block["docs"], F.lit("")).alias("description"), value("culture")("culture"),
        value("sourceQueryCulture")("source_query_culture"), F.coalesce(body.rlike(r"(?m)^\tdiscourageImplicitMeasures"), F.lit(False)).alias("discourage_implicit"),
        value("valueFilterBehavior")("value_filter"), value("defaultPowerBIDataSourceVersion")("data_source_version"),
    )
    return found.join(level, "root", "left").join(cultures, "root", "left").withColumn("cultures", F.coalesce("cultures", F.array().cast("array<string>")))
