"""The data content of the reports: each function returns the rows of one table of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import patterns as P
from estatelens.functions import text
from estatelens.operators import impact, pages, refs, roles, usage
from estatelens.operators.numbering import number_rows

# Cut lengths (characters kept, limit) and list sizes
EXPRESSION_CUT = (77, 80)
FUNCTION_DESCRIPTION_CUT = (97, 100)
MEASURE_DESCRIPTION_CUT = (100, 100)
GLOSSARY_DESCRIPTION_CUT = (110, 110)
BIGGEST_TABLES = 10
ER_TABLES, ER_COLUMNS = 30, 10
KIND_ORDER = ["Table", "Calc group", "Measure", "UDF", "Calc item", "Column"]
DOCUMENTS = {  # document: (in lite mode, left out when empty)
    "Model": (True, False), "DataDictionary": (False, False), "Sources": (True, False), "Measures": (True, False),
    "Functions": (True, True), "CalcGroups": (True, True), "Pages": (True, False), "Improvements": (True, False), "Index": (False, False),
}


def dash(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(value)


# ---- model ------------------------------------------------------------------------------------------------------


def model_properties(estate: Estate, totals: DataFrame) -> DataFrame:
    """Headline row of each model."""
    cultures = F.when(F.size("cultures") > 0, F.array_join("cultures", ", ")).otherwise(
        F.when(F.col("culture") == "", "unknown").otherwise(F.col("culture"))
    )
    return estate.models.join(totals, "model_id").select(
        "model_id", "name", F.col("compatibility_level").cast("string").alias("compatibility_level"), cultures.alias("culture_list"),
        F.when(F.col("discourage_implicit"), "Discouraged").otherwise("Allowed").alias("implicit_measures"),
        F.when(F.col("value_filter") == "", "Automatic (default)").otherwise(F.col("value_filter")).alias("value_filter"),
        *[c for c in totals.columns if c != "model_id"],
    )


def relationship_inventory(relationships: DataFrame) -> DataFrame:
    numbered = number_rows(relationships, ["model_id"], [F.col("rel_no").asc()], "row_no")
    ends = [F.concat(f"{e}_table", F.lit("["), f"{e}_column", F.lit("]")) for e in ("from", "to")]
    return numbered.select(
        "model_id", "row_no", ends[0].alias("from_end"), ends[1].alias("to_end"),
        F.concat("from_card", F.lit(" → "), "to_card").alias("cardinality"),
        F.when(F.col("cross_filter") == "bothDirections", "both ↔").otherwise("single →").alias("filter"),
        F.when(F.col("is_active"), "✓").otherwise("—").alias("active"),
    )


def expression_inventory(expressions: DataFrame) -> DataFrame:
    value = F.col("value")
    cluster, database = (F.regexp_extract(value, P.REMOTE_CLUSTER_AND_DATABASE, n) for n in (1, 2))
    remote = F.concat(F.lit("cluster "), cluster, F.lit(" · database "), database)
    shown = F.when(value.rlike(P.REMOTE_CLUSTER_AND_DATABASE), remote).otherwise(text.truncated(value, *EXPRESSION_CUT))
    return expressions.select(
        "model_id", "name", F.when(F.col("kind") == "parameter", "Parameter").otherwise("M expression").alias("kind"),
        shown.alias("value"), dash(F.col("description")).alias("description"),
    )


def biggest_tables(summary: DataFrame, limit: int = BIGGEST_TABLES) -> DataFrame:
    """User tables with most columns, per model."""
    from estatelens.operators.numbering import capped

    user = summary.where(F.col("origin") == "user")
    top = capped(user, ["model_id"], [F.col("column_count").desc(), F.col("table_name").asc()], limit)
    return top.select("model_id", F.col("item_no").alias("row_no"), "table_name", "role", "column_count", "measure_count")


def function_summary(functions: DataFrame) -> DataFrame:
    return refs.without_about(functions).select(
        "model_id", "name", text.parameter_count(F.col("parameters")).cast("long").alias("parameters"),
        dash(text.truncated(F.col("description"), *FUNCTION_DESCRIPTION_CUT)).alias("description"),
    )


def calc_group_summary(calc_items: DataFrame) -> DataFrame:
    return calc_items.groupBy("model_id", "group_name").agg(
        F.count(F.lit(1)).alias("items"), F.min("precedence").alias("precedence")
    )


def page_table(summary: DataFrame) -> DataFrame:
    """Pages by name, numbered, with the flag for names used twice."""
    named = pages.display_names(summary)
    joined = summary.join(named, ["model_id", "page_id"])
    numbered = number_rows(joined, ["model_id"], [F.col("name").asc(), F.col("page_id").asc()], "row_no")
    return numbered.select(
        "model_id", "row_no", "page_id", "display_name", "is_duplicate", F.when(F.col("hidden"), "Hidden").otherwise("Visible").alias("visibility"),
        "visual_count", "measure_count", "column_count", "slicer_count",
    )


# ---- measures, functions, calculation groups --------------------------------------------------------------------


def measures_lite(estate: Estate, statuses: DataFrame) -> DataFrame:
    described = F.regexp_replace("description", r"\s+", " ")
    shown = estate.measures.select(  # what is shown of a body, not the body, goes through the join
        "model_id", "name", "table_name", dash(F.col("format_string")).alias("format"),
        dash(text.truncated(described, *MEASURE_DESCRIPTION_CUT)).alias("description"), text.is_external(F.col("body")).alias("is_proxy"),
    )
    return shown.join(statuses.select("model_id", "table_name", "name", "status"), ["model_id", "table_name", "name"])


def measures_detailed(estate: Estate, statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form: one row per measure and fact (status, visuals, pages, remote model, each dependency, each user)."""

    def fact(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select("model_id", "name", F.lit(name).alias("fact"), value.cast("string").alias("value"))

    remote = refs.external_proxies(estate.measures, estate.expressions)
    proxies = remote.select("model_id", "table_name", "name", F.lit(True).alias("_proxy"))
    shown = statuses.join(proxies, ["model_id", "table_name", "name"], "left")
    status = F.when(F.col("_proxy"), "external proxy").otherwise(F.col("status"))
    parts = [
        fact(shown, "status", status), fact(statuses, "visuals", F.col("usage_count")), fact(statuses, "pages", F.col("page_count")),
        fact(estate.measures, "letter", text.letter_bucket(F.col("name"))),
        fact(remote, "remote model", F.col("external_model")), fact(remote, "remote measure", F.col("remote_name")),
        fact(remote, "remote type", F.col("remote_type")), fact(remote.where(F.col("cluster").isNotNull()), "cluster", F.col("cluster")),
        fact(edges.withColumnRenamed("src", "name"), "depends on", F.col("dst")),
        fact(edges.withColumnRenamed("dst", "name"), "used by", F.col("src")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def functions_reference(estate: Estate) -> DataFrame:
    """Signature, parameter count and number of calling measures per function."""
    functions = refs.without_about(estate.functions)
    uses = refs.function_uses(functions, estate.measures).groupBy("model_id", F.col("function").alias("name")).agg(
        F.count(F.lit(1)).alias("used_by")
    )
    params = text.parameters(F.col("parameters"))
    shown = F.transform(params, lambda p: F.when(p["type"] != "", F.concat(p["name"], F.lit(" : "), p["type"])).otherwise(p["name"]))
    signature = F.concat("name", F.lit("("), F.array_join(shown, ", "), F.lit(")"))
    return functions.join(uses, ["model_id", "name"], "left").select(
        "model_id", "name", signature.alias("signature"), F.size(params).cast("long").alias("parameters"),
        F.coalesce("used_by", F.lit(0).cast("long")).alias("used_by"),
    )


def calc_groups_reference(estate: Estate) -> DataFrame:
    return number_rows(
        estate.calc_items, ["model_id", "group_name"], [F.col("ordinal").asc(), F.col("name").asc()], "item_no"
    ).select("model_id", "group_name", "precedence", "item_no", "ordinal", "name", "body", "format_expr", "description")


# ---- data dictionary --------------------------------------------------------------------------------------------


def data_dictionary(estate: Estate, summary: DataFrame) -> DataFrame:
    """Columns of user tables by role, table and key order, with their constraints."""
    columns = roles.without_calc_names(estate.columns, estate.calc_items)
    numbered = roles.numbered_columns(columns, estate.relationships)
    tables = summary.where(F.col("origin") == "user").select("model_id", "table_name", "role", roles.role_rank().alias("role_order"))
    category = F.when(F.col("data_category") == "Uncategorized", "").otherwise(F.col("data_category"))
    summarize = F.when(F.col("summarize_by") == "none", "").otherwise(F.col("summarize_by"))
    return numbered.join(tables, ["model_id", "table_name"]).select(
        "model_id", "role_order", "role", "table_name", "column_no", "name", "data_type", roles.constraints().alias("constraints"),
        dash(summarize).alias("summarize_by"), dash(F.col("sort_by_column")).alias("sort_by"), dash(category).alias("category"),
        dash(F.col("format_string")).alias("format"), dash(F.col("description")).alias("description"),
    )


def hierarchy_levels(hierarchies: DataFrame) -> DataFrame:
    return number_rows(
        hierarchies, ["model_id", "table_name", "hierarchy"], [F.col("level_no").asc(), F.col("level").asc()], "order_no"
    ).select("model_id", "table_name", "hierarchy", "order_no", "level", "column_name", dash(F.col("description")).alias("description"))


# ---- sources ----------------------------------------------------------------------------------------------------


def source_report(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """Regular tables with bucket, mode, kind, counts and the file or expression behind them."""
    first = impact.first_per_group(
        sources.select(*impact.KEYS, "mode", "kind", "expression_source", "source_type", "source_location"),
        ["model_id", "table_name"], [F.col("part_no")],
    )
    tables = impact.regular_tables(summary).join(first, ["model_id", "table_name"], "left")
    file = F.when(
        F.col("source_type").isin(P.FILE_SOURCE_TYPES), F.regexp_extract("source_location", r"(?s)([^/\\]*)\z", 1)
    ).otherwise("")
    shared = F.when(F.coalesce("expression_source", F.lit("")) != "", F.concat(F.lit("expr: "), "expression_source")).otherwise("")
    detail = F.when(file != "", file).otherwise(shared)
    return tables.select(
        "model_id", impact.source_bucket(F.col("source_type"), F.col("source_location")).alias("bucket"), "table_name",
        dash(F.col("mode")).alias("mode"), dash(F.col("kind")).alias("kind"), "column_count", "measure_count", dash(detail).alias("detail"),
    )


# ---- pages ------------------------------------------------------------------------------------------------------


def page_index(summary: DataFrame) -> DataFrame:
    """Visible pages by weight, then hidden ones by name, numbered."""
    return number_rows(summary, ["model_id"], pages.page_order(summary), "row_no").select(
        "model_id", "row_no", "page_id", "name", "hidden", "visual_count", "measure_count", "column_count", "slicer_count"
    )


def visual_bindings(estate: Estate) -> DataFrame:
    """One row per visual and bound field."""
    bound = pages.known_bindings(estate)
    return bound.select("model_id", "page_id", "visual_id", "visual_type", "title", "kind", "table_name", "field_name")


# ---- glossary ---------------------------------------------------------------------------------------------------


def glossary(estate: Estate, statuses: DataFrame, summary: DataFrame) -> DataFrame:
    """Every named thing of a model: name, kind, parent, note, description, letter."""

    def notes(*parts: Column) -> Column:
        return F.concat_ws(", ", *parts)

    def entry(df: DataFrame, kind: Column, name: str, parent: Column, note: Column, description: str = "description") -> DataFrame:
        return df.select(
            "model_id", F.col(name).alias("name"), kind.alias("kind"), parent.alias("parent"), note.alias("note"),
            F.coalesce(description, F.lit("")).alias("_d"),
        )

    none = F.lit("")
    tables = summary.where(F.col("origin") == "user")
    table_note = notes(
        F.when(F.col("is_calc_group"), "calc group"), F.when(F.col("parameter_kind") == "field", "field parameter"),
        F.when(F.col("parameter_kind") == "compositeModelProxy", "composite proxy"), F.when(F.col("is_calculated"), "calculated table"),
    )
    user = ~roles.is_auto_date(F.col("table_name"))
    columns = roles.without_calc_names(estate.columns, estate.calc_items).where(user)
    column_note = notes(
        F.when(F.col("is_key"), "key"), F.when(F.col("is_calculated"), "calculated"), F.when(F.col("is_hidden"), "hidden")
    )
    keys = ["model_id", "table_name", "name"]
    body = F.col("body")
    proxy = F.concat(F.lit("external proxy → "), text.external_model(body), F.lit("["), text.external_name(body), F.lit("]"))
    shown = estate.measures.where(user).select(*keys, "description", F.when(text.is_external(body), proxy).alias("_proxy"))
    measures = shown.join(statuses.select(*keys, "status"), keys)
    measure_note = notes(F.col("_proxy"), F.when(F.col("status") != "direct", F.col("status")))
    parts = [
        entry(tables, F.when(F.col("is_calc_group"), "Calc group").otherwise("Table"), "table_name", none, table_note),
        entry(columns, F.lit("Column"), "name", F.col("table_name"), column_note),
        entry(measures, F.lit("Measure"), "name", F.col("table_name"), measure_note),
        entry(refs.without_about(estate.functions), F.lit("UDF"), "name", none, F.coalesce("parameters", none)),
        entry(estate.calc_items, F.lit("Calc item"), "name", F.col("group_name"), none),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.select(
        "model_id", "name", "kind", "parent", "note", text.truncated(F.col("_d"), *GLOSSARY_DESCRIPTION_CUT).alias("description"),
        text.letter_bucket(F.col("name"), trim=False).alias("letter"),
    )


def glossary_counts(entries: DataFrame) -> DataFrame:
    """Entries per letter and kind, per letter and in all; ``all`` marks a total."""
    rolled = entries.rollup("model_id", "letter", "kind").agg(
        F.count(F.lit(1)).alias("entries"), F.grouping("model_id").alias("_m"), F.grouping("letter").alias("_l"), F.grouping("kind").alias("_k")
    ).where(F.col("_m") == 0)
    return rolled.select(
        "model_id", F.when(F.col("_l") == 1, "all").otherwise(F.col("letter")).alias("letter"),
        F.when(F.col("_k") == 1, "all").otherwise(F.col("kind")).alias("kind"), "entries",
    )


# ---- diagrams, tiles, modes, anchors ----------------------------------------------------------------------------


def er_tables(summary: DataFrame) -> DataFrame:
    """The tables a model's diagram shows: the first user tables by name, calculation groups left out."""
    from estatelens.operators.numbering import capped

    user = summary.where((F.col("origin") == "user") & ~F.col("is_calc_group")).select("model_id", "table_name")
    return capped(user, ["model_id"], [F.col("table_name").asc()], ER_TABLES).select("model_id", "table_name")


def er_columns(estate: Estate, summary: DataFrame) -> DataFrame:
    """Up to ten columns per shown table: keys, foreign keys, others; ``more`` counts those left out."""
    from estatelens.operators.numbering import capped

    keyed = roles.column_keys(estate.columns, estate.relationships).join(er_tables(summary), ["model_id", "table_name"], "left_semi")
    top = capped(keyed, ["model_id", "table_name"], roles.column_order(), ER_COLUMNS)
    badge = F.when(F.col("is_key") | F.col("is_inferred_pk"), "PK").when(F.col("is_fk"), "FK").otherwise("")
    return top.select("model_id", "table_name", "item_no", "name", "data_type", badge.alias("badge"), "more")


def usage_tiles(totals: DataFrame, page_totals: DataFrame) -> DataFrame:
    both = totals.join(page_totals.select("model_id", "visible", "hidden_pages"), "model_id")
    return both.select(
        "model_id", *[(F.col(f"measures_{s}") + F.col(f"columns_{s}")).alias(s) for s in ("direct", "indirect", "unused")],
        "pages", "visible", "hidden_pages", "visuals",
    )


def emitted_documents(estate: Estate) -> DataFrame:
    """Which documents each model gets per mode: reference documents only in detail, empty ones left out."""
    wanted = [(d, m) for d, (lite, _) in DOCUMENTS.items() for m in ("lite", "detailed") if lite or m == "detailed"]
    catalogue = F.explode(F.array(*[F.struct(F.lit(d).alias("doc"), F.lit(m).alias("mode")) for d, m in wanted]))
    listed = estate.models.select("model_id", catalogue.alias("_d")).select("model_id", "_d.*")
    filled = refs.without_about(estate.functions).select("model_id", F.lit("Functions").alias("doc")).union(
        estate.calc_items.select("model_id", F.lit("CalcGroups"))
    ).distinct()
    optional = [d for d, (_, skip) in DOCUMENTS.items() if skip]
    kept = listed.where(F.col("doc").isin(optional)).join(filled, ["model_id", "doc"], "left_semi")
    return listed.where(~F.col("doc").isin(optional)).unionByName(kept)
