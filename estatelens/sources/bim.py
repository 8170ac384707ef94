"""Models stored as one JSON file (``model.bim``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import patterns as P
from estatelens.functions.text import trimmed
from estatelens.sources.files import at, path_part

# Texts may be a string or a list of lines, so they are read as variants.
SCHEMA = """
compatibilityLevel int,
model struct<name: string, description: variant, culture: string, sourceQueryCulture: string, discourageImplicitMeasures: boolean,
 valueFilterBehavior: string, defaultPowerBIDataSourceVersion: string, cultures: array<struct<name: string>>,
 tables: array<struct<name: string, description: variant,
  partitions: array<struct<name: string, mode: string, source: struct<type: string, expression: variant, expressionSource: string>>>,
  hierarchies: array<struct<name: string, description: variant, levels: array<struct<name: string, column: string, description: variant>>>>,
  measures: array<struct<name: string, expression: variant, formatString: string, description: variant, displayFolder: string>>,
  columns: array<struct<name: string, type: string, dataType: string, isKey: boolean, isHidden: boolean, description: variant, displayFolder: string,
   summarizeBy: string, sortByColumn: string, dataCategory: string, formatString: string, extendedProperties: array<struct<name: string>>>>,
  calculationGroup: struct<precedence: int, calculationItems: array<struct<name: string, ordinal: int, expression: variant, formatStringDefinition: variant, description: string>>>>>,
 relationships: array<struct<fromTable: string, fromColumn: string, toTable: string, toColumn: string, isActive: boolean, fromCardinality: string,
  toCardinality: string, crossFilteringBehavior: string>>,
 expressions: array<struct<name: string, kind: string, expression: variant, description: variant>>>
"""
LITERAL = r"""(?s)^\s*(["']).*\1\s*$"""
PLAIN_LITERAL = r"^(true|false|\d+(\.\d+)?)$"


def joined(value: Column) -> Column:
    """A text given as string or as list of lines."""
    rows = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n")
    return F.when(value.isNull(), "").when(F.schema_of_variant(value).startswith("ARRAY"), rows).otherwise(
        F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    )


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def parsed(files: DataFrame) -> DataFrame:
    """``(root, _b)``: one parsed model per folder; the file at the folder's root wins over the one below it.

    Only the rare nested files are joined, so model texts are not shuffled.
    """
    found = at(files, "bim").select(path_part("bim").alias("root"), "path", "content")
    nested = F.col("path").endswith("/definition/model.bim")
    direct = found.where(~nested)
    chosen = direct.unionByName(found.where(nested).join(direct.select("root"), "root", "left_anti"))
    return chosen.select("root", F.from_json("content", SCHEMA).alias("_b"))


def _tables(models: DataFrame) -> DataFrame:
    return models.select("root", F.explode("_b.model.tables").alias("_t")).withColumn("table_name", F.col("_t.name"))


def tables(models: DataFrame) -> DataFrame:
    return _tables(models).select("root", "table_name", joined(F.col("_t.description")).alias("description"), F.col("_t.calculationGroup").isNotNull().alias("is_calc_group"))


def columns(models: DataFrame) -> DataFrame:
    each = _tables(models).select("root", "table_name", F.explode("_t.columns").alias("_c")).where(F.coalesce("_c.type", F.lit("")) != "rowNumber")
    c = F.col("_c")
    return each.select(
        "root", "table_name", c["name"].alias("name"), F.coalesce(F.nullif(c["dataType"], F.lit("")), F.lit("string")).alias("data_type"),
        joined(c["description"]).alias("description"), F.coalesce(c["isKey"], F.lit(False)).alias("is_key"),
        F.coalesce(c["isHidden"], F.lit(False)).alias("is_hidden"), F.coalesce(c["type"] == "calculated", F.lit(False)).alias("is_calculated"),
        F.coalesce(F.exists(c["extendedProperties"], lambda p: p["name"] == "ParameterMetadata"), F.lit(False)).alias("has_param_metadata"),
        blank(c["summarizeBy"]).alias("summarize_by"), blank(c["sortByColumn"]).alias("sort_by_column"), blank(c["dataCategory"]).alias("data_category"),
        blank(c["formatString"]).alias("format_string"), blank(c["displayFolder"]).alias("display_folder"),
    )


def measures(models: DataFrame) -> DataFrame:
    each, m = _tables(models).select("root", "table_name", F.explode("_t.measures").alias("_m")), F.col("_m")
    return each.select(
        "root", "table_name", m["name"].alias("name"), joined(m["expression"]).alias("body"), blank(m["formatString"]).alias("format_string"),
        joined(m["description"]).alias("description"), blank(m["displayFolder"]).alias("display_folder"),
    )


def partitions(models: DataFrame) -> DataFrame:
    each, p = _tables(models).select("root", "table_name", F.posexplode("_t.partitions").alias("part_no", "_p")), F.col("_p")
    source = p["source"]
    body, kind = joined(source["expression"]), blank(source["type"])
    is_text = F.schema_of_variant(source["expression"]) == "STRING"
    shared = F.coalesce(source["expressionSource"], F.when((kind == "entity") & is_text, body), F.lit(""))
    return each.select(
        "root", "table_name", "part_no", blank(p["name"]).alias("name"),
        F.coalesce(F.nullif(p["mode"], F.lit("")), F.nullif(kind, F.lit("")), F.lit("import")).alias("mode"), kind.alias("kind"),
        shared.alias("expression_source"), body.alias("m_body"),
    )


def hierarchies(models: DataFrame) -> DataFrame:
    each = _tables(models).select("root", "table_name", F.explode("_t.hierarchies").alias("_h"))
    levels = each.select("root", "table_name", F.col("_h.name").alias("hierarchy"), F.posexplode("_h.levels").alias("level_no", "_l"))
    level = F.col("_l")
    return levels.select("root", "table_name", "hierarchy", "level_no", blank(level["name"]).alias("level"), blank(level["column"]).alias("column_name"), joined(level["description"]).alias("description"))


def relationships(models: DataFrame) -> DataFrame:
    each, r = models.select("root", F.posexplode("_b.model.relationships").alias("rel_no", "_r")), F.col("_r")
    ends = [blank(r[f"{end}{part}"]).alias(f"{end}_{part.lower()}") for end in ("from", "to") for part in ("Table", "Column")]
    return each.select(
        "root", F.col("rel_no").cast("long").alias("rel_no"), *ends, F.coalesce(r["isActive"], F.lit(True)).alias("is_active"),
        one_of(F.lower(r["fromCardinality"]), ["one", "many"], "many").alias("from_card"),
        one_of(F.lower(r["toCardinality"]), ["one", "many"], "one").alias("to_card"),
        one_of(r["crossFilteringBehavior"], ["bothDirections", "oneDirection"], "oneDirection").alias("cross_filter"),
    )


def _expressions(models: DataFrame) -> DataFrame:
    each, e = models.select("root", F.explode("_b.model.expressions").alias("_e")), F.col("_e")
    return each.select("root", blank(e["name"]).alias("name"), blank(e["kind"]).alias("_kind"), joined(e["expression"]).alias("_text"), joined(e["description"]).alias("description"))


def functions(models: DataFrame) -> DataFrame:
    value = F.col("_text")
    params = trimmed(F.regexp_replace(F.regexp_extract(value, P.FUNCTION_PARAMETERS, 1), r"\s+", " "))
    return _expressions(models).where(value.rlike(P.FUNCTION_PARAMETERS)).select(
        "root", "name", params.alias("parameters"), trimmed(F.regexp_replace(value, P.FUNCTION_HEAD, "")).alias("body"), "description"
    )


def expressions(models: DataFrame) -> DataFrame:
    value = trimmed(F.col("_text"))
    literal = value.rlike(LITERAL) | value.rlike(PLAIN_LITERAL)
    return _expressions(models).where((F.col("_kind") == "m") & ~F.col("_text").rlike(P.FUNCTION_PARAMETERS)).select(
        "root", "name", F.when(literal, "parameter").otherwise("m").alias("kind"), value.alias("value"), F.lit("").alias("metadata"), "description"
    )


def calc_items(models: DataFrame) -> DataFrame:
    group = F.col("_t.calculationGroup")
    each = _tables(models).where(group.isNotNull()).select(
        "root", F.col("table_name").alias("group_name"), F.coalesce(group["precedence"], F.lit(0)).alias("precedence"), F.posexplode(group["calculationItems"]).alias("_n", "_i")
    )
    item = F.col("_i")
    return each.select(
        "root", "group_name", "precedence", F.coalesce(item["ordinal"], "_n").alias("ordinal"), blank(item["name"]).alias("name"),
        joined(item["expression"]).alias("body"), joined(item["formatStringDefinition"]).alias("format_expr"), blank(item["description"]).alias("description"),
    )


def models(found: DataFrame) -> DataFrame:
    m = F.col("_b.model")
    return found.select(
        "root", F.coalesce(m["name"], F.lit("Model")).alias("name"), joined(m["description"]).alias("description"), blank(m["culture"]).alias("culture"),
        blank(m["sourceQueryCulture"]).alias("source_query_culture"),
        F.coalesce(F.array_sort(F.filter(F.transform(m["cultures"], lambda c: c["name"]), lambda c: c.isNotNull())), F.array().cast("array<string>")).alias("cultures"),
        F.col("_b.compatibilityLevel").alias("compatibility_level"), F.coalesce(m["discourageImplicitMeasures"], F.lit(False)).alias("discourage_implicit"),
        blank(m["valueFilterBehavior"]).alias("value_filter"), blank(m["defaultPowerBIDataSourceVersion"]).alias("data_source_version"),
    )
