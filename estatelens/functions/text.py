"""String functions over expression text, as Spark column expressions (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions import patterns as P

STRIP = f"{P.BLOCK_COMMENT}|{P.LINE_COMMENT}|{P.STRING}"


def trimmed(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(P.WHITESPACE))


def non_empty(text: Column) -> Column:
    return F.coalesce(F.length(trimmed(text)) > 0, F.lit(False))


def undouble(text: Column) -> Column:
    return F.replace(text, F.lit('""'), F.lit('"'))


def strip_comments_and_strings(body: Column) -> Column:
    return F.regexp_replace(body, STRIP, "")


def qualified_refs(clean: Column) -> Column:
    """Distinct ``T[c]`` references of a stripped body, as array<struct<ref_table, ref_column>>."""

    def parts(ref: Column) -> Column:
        table = F.concat(F.regexp_extract(ref, P.QUALIFIED_PARTS, 1), F.regexp_extract(ref, P.QUALIFIED_PARTS, 2))
        return F.struct(trimmed(table).alias("ref_table"), trimmed(F.regexp_extract(ref, P.QUALIFIED_PARTS, 3)).alias("ref_column"))

    found = F.transform(F.regexp_extract_all(clean, F.lit(P.QUALIFIED), F.lit(0)), parts)
    return F.array_distinct(F.filter(found, lambda r: (r["ref_table"] != "") & (r["ref_column"] != "")))


def bare_refs(clean: Column) -> Column:
    """Distinct ``[x]`` references of a stripped body, qualified references masked out first."""
    masked = F.regexp_replace(clean, P.QUALIFIED, " ")
    found = F.transform(F.regexp_extract_all(masked, F.lit(P.BARE), F.lit(1)), trimmed)
    return F.array_distinct(F.filter(found, lambda r: r != ""))


def bracket_tokens(body: Column) -> Column:
    """Every ``[x]`` of the raw text, comments and strings included."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(P.TOKEN), F.lit(1)))


def is_external(body: Column) -> Column:
    return body.rlike(P.EXTERNAL)


def external_name(body: Column) -> Column:
    return undouble(F.regexp_extract(body, P.EXTERNAL, 1))


def external_type(body: Column) -> Column:
    return F.upper(F.regexp_extract(body, P.EXTERNAL, 2))


def external_model(body: Column) -> Column:
    return undouble(F.regexp_extract(body, P.EXTERNAL, 3))


def lines(body: Column) -> Column:
    return F.split(body, "\n")


def dedent(body: Column) -> Column:
    """Remove the indentation all non-blank lines share.

    The margin becomes part of a pattern, so it is worked out once per text and not once per line.
    """
    indents = F.regexp_extract_all(body, F.lit(r"(?md)^([ \t]*+)(?=\S)"), F.lit(1))
    margin = F.coalesce(F.array_min(F.transform(indents, F.length)), F.lit(0))
    blank = "[" + P.WHITESPACE.replace("\n", "") + "]"
    return F.when(margin == 0, body).otherwise(F.regexp_replace(body, F.concat(F.lit(f"(?md)^{blank}{{"), margin.cast("string"), F.lit("}")), F.lit("")))


def capped_body(body: Column, cap: int = P.BODY_CAP) -> Column:
    """Dedent, trim and cap a body for display, saying how much was cut."""
    text = trimmed(dedent(body))
    more = F.concat(F.lit("\n\n… (truncated — "), (F.length(text) - cap).cast("string"), F.lit(" more chars)"))
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.substring(text, 1, cap), more))


def non_blank_lines(body: Column) -> Column:
    return F.size(F.filter(lines(body), non_empty))


def normalized_body(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def parameters(text: Column) -> Column:
    """``"A : T, B : U"`` as array<struct<name, type>>; the type is empty when absent."""

    def one(part: Column) -> Column:
        part = trimmed(part)
        name = F.regexp_extract(part, r"(?s)^(.*?)\s*(?::|\z)", 1)
        kind = trimmed(F.regexp_extract(part, r"(?s)^.*?\s*:\s*(.*)\z", 1))
        return F.struct(trimmed(name).alias("name"), F.regexp_replace(kind, r"\s*:\s*", ":").alias("type"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), one), lambda p: p["name"] != "")


def parameter_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), ","), non_empty))


def github_slug(heading: Column) -> Column:
    slug = F.regexp_replace(F.lower(heading), r"[^\w\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(slug, r"\s+", "-"), r"-+", "-")
    return F.btrim(slug, F.lit("-"))


def wiki_slug(heading: Column) -> Column:
    slug = F.regexp_replace(F.lower(heading), r"[:.,/&()!?'\"`]", "")
    slug = F.regexp_replace(F.regexp_replace(slug, r"[^\w\-]+", "-"), r"-+", "-")
    return F.btrim(slug, F.lit("-"))


def letter_bucket(name: Column, trim: bool = True) -> Column:
    first = F.upper(F.left(trimmed(name) if trim else name, F.lit(1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))


def truncated(text: Column, keep: int, limit: int) -> Column:
    """``text`` when at most ``limit`` characters, else its first ``keep`` characters and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n\r]'), quoted).otherwise(F.coalesce(value, F.lit("")))


def page_display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("yes")).otherwise(F.lit("no"))
