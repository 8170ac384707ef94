"""Audit rules: one long ``findings`` frame, a row per affected entity.

``(model_id, severity, check_id, entity, detail)``.  Rules about a whole model have the model as entity.  Lists are
never folded into one row: a rule that hits a third of the estate stays as many rows; ``numbering.capped`` makes the
short list a report shows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import patterns as P
from estatelens.functions import text
from estatelens.operators import graph, pages, refs, roles, usage
from estatelens.session import checkpoint

# Severities in display order, thresholds, numeric types, URL categories
SEVERITIES = ["high", "medium", "low", "info", "good"]
TABLE_DESCRIPTION_SHARE = 0.30
MEASURE_DESCRIPTION_SHARE = 0.30
COLUMN_DESCRIPTION_SHARE = 0.50
MEASURE_UTILISATION = 0.85
COLUMN_UTILISATION = 0.75
CYCLE_FREE_MIN_MEASURES = 5
NUMERIC_TYPES = ["int64", "decimal", "double", "currency"]
URL_CATEGORIES = ["webUrl", "imageUrl"]
SHOWN_ITEMS = {
    "A2": 5, "A3": 20, "A5": 15, "A6": 20, "A7": 15, "A9": 15, "A10": 15, "A11": 10, "A12": 10, "A13": 10, "A15": 20, "A17": 15, "A18": 20,
}
DEFAULT_SHOWN = 10


def _rows(df: DataFrame, severity: str, check: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(
        "model_id", F.lit(severity).alias("severity"), F.lit(check).alias("check_id"), entity.alias("entity"),
        F.coalesce(detail, F.lit("")).alias("detail"),
    )


def _label() -> Column:
    return F.concat("table_name", F.lit("["), "name", F.lit("]"))


def _share_rule(df: DataFrame, share: float, severity: str, check: str, entity: Column) -> DataFrame:
    """Rows without a description, in models where their share reaches the threshold."""
    missing = df.withColumn("_missing", ~text.non_empty(F.coalesce("description", F.lit(""))))
    shares = missing.groupBy("model_id").agg(F.count_if("_missing").alias("_m"), F.count(F.lit(1)).alias("_n"))
    hit = shares.where((F.col("_m") > 0) & (F.col("_m") >= F.col("_n") * share)).select("model_id")
    flagged = missing.where(F.col("_missing")).join(hit, "model_id", "left_semi")
    return _rows(flagged, severity, check, entity, F.lit(""))


def duplicate_bodies(measures: DataFrame) -> DataFrame:
    """Measures whose normalized body another measure of the model has: ``(model_id, body_hash, copies, table, name)``.

    Grouped by a 256-bit digest so long bodies are not shuffled; members stay rows, a body a third of the estate
    shares never lands in one array.  The digests are written once, so every text is read and normalized once.
    """
    norm = text.normalized_body(F.col("body"))
    digest = F.when(F.length(norm) >= P.DUPLICATE_MIN_LENGTH, F.sha2(norm, 256))
    hashed = checkpoint(measures.select("model_id", "table_name", "name", digest.alias("body_hash"))).where(F.col("body_hash").isNotNull())
    groups = hashed.groupBy("model_id", "body_hash").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return hashed.join(groups, ["model_id", "body_hash"])


def long_bodies(measures: DataFrame, threshold: int = P.LONG_BODY_LINES) -> DataFrame:
    return measures.withColumn("body_lines", text.non_blank_lines(F.col("body"))).where(F.col("body_lines") >= threshold)


def category_mismatches(columns: DataFrame, mode: str = "strict") -> DataFrame:
    """URL categories on columns that are not strings; ``compat`` compares the category with case."""
    category, known = F.col("data_category"), URL_CATEGORIES
    if mode == "strict":
        category, known = F.lower(category), [c.lower() for c in URL_CATEGORIES]
    return columns.where(category.isin(known) & (F.lower("data_type") != "string"))


def numeric_without_format(columns: DataFrame) -> DataFrame:
    bare = F.coalesce("format_string", F.lit("")) == ""
    return columns.where(F.lower("data_type").isin(NUMERIC_TYPES) & bare & ~F.col("is_key"))


class Audit:
    """The inputs the rules share, each built when the first rule needs it; ``RULES`` maps a check to its findings."""

    def __init__(self, estate: Estate, mode: str = "strict", column_mode: str = "compat"):
        self.estate, self.mode, self.column_mode = estate, mode, column_mode

    @cached_property
    def edges(self) -> DataFrame:
        return checkpoint(refs.dependencies(self.estate.measures, self.mode))

    @cached_property
    def column_usage(self) -> DataFrame:
        return checkpoint(usage.field_usage(self.estate.bindings).where(F.col("kind") == "column"))

    @cached_property
    def measure_status(self) -> DataFrame:
        return checkpoint(usage.measure_status(self.estate, self.mode, self.edges))

    @cached_property
    def column_status(self) -> DataFrame:
        return checkpoint(usage.column_status(self.estate, self.measure_status, self.column_mode, self.column_usage))

    @cached_property
    def summary(self) -> DataFrame:
        return checkpoint(roles.table_summary(self.estate))

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges)

    @staticmethod
    def user(df: DataFrame) -> DataFrame:
        return df.where(~roles.is_auto_date(F.col("table_name")))

    def auto_date(self) -> DataFrame:
        return _rows(self.summary.where(F.col("origin") == "auto-date"), "high", "A1", F.col("table_name"), F.lit(""))

    def circular(self) -> DataFrame:
        return _rows(self.cycles, "high", "A2", F.col("node"), F.col("component"))

    def broken(self) -> DataFrame:
        e = self.estate
        found = refs.broken_references(e.measures, e.columns, e.calc_items, e.functions)
        return _rows(found, "high", "A3", F.col("where"), F.concat("broken", F.lit(" ("), "reason", F.lit(")")))

    def calculated_direct(self) -> DataFrame:
        hit = self.summary.where((F.col("origin") == "user") & F.col("is_calculated") & F.col("has_direct_query"))
        return _rows(hit, "high", "A4", F.col("table_name"), F.lit(""))

    def unused_measures(self) -> DataFrame:
        return _rows(self.user(self.measure_status).where(F.col("status") == "unused"), "medium", "A5", _label(), F.lit(""))

    def dead_chain(self) -> DataFrame:
        found = graph.dead_chains(self.edges, self.user(self.measure_status))
        return _rows(found, "medium", "A6", F.col("name"), F.lit(""))

    def unused_columns(self) -> DataFrame:
        keys = self.estate.columns.where(F.col("is_key")).select("model_id", "table_name", "name")
        unused = self.user(self.column_status).where(F.col("status") == "unused")
        return _rows(unused.join(keys, ["model_id", "table_name", "name"], "left_anti"), "medium", "A7", _label(), F.lit(""))

    def dead_relationships(self) -> DataFrame:
        found = refs.inactive_without_caller(self.estate.relationships, self.estate.measures)
        ends = [F.concat(f"{e}_table", F.lit("["), f"{e}_column", F.lit("]")) for e in ("from", "to")]
        return _rows(found, "medium", "A8", F.concat(ends[0], F.lit(" → "), ends[1]), F.lit(""))

    def undescribed_tables(self) -> DataFrame:
        user = self.summary.where(F.col("origin") == "user")
        return _share_rule(user, TABLE_DESCRIPTION_SHARE, "medium", "A9", F.col("table_name"))

    def undescribed_measures(self) -> DataFrame:
        return _share_rule(self.user(self.estate.measures), MEASURE_DESCRIPTION_SHARE, "medium", "A10", _label())

    def long_expressions(self) -> DataFrame:
        return _rows(long_bodies(self.estate.measures), "medium", "A11", _label(), F.col("body_lines").cast("string"))

    def duplicates(self) -> DataFrame:
        return _rows(duplicate_bodies(self.estate.measures), "medium", "A12", _label(), F.col("body_hash"))

    def empty_pages(self) -> DataFrame:
        return _rows(pages.empty_visible_pages(pages.page_summary(self.estate)), "medium", "A13", F.col("name"), F.lit(""))

    def url_categories(self) -> DataFrame:
        found = category_mismatches(self.user(self.estate.columns), self.mode)
        return _rows(found, "medium", "A14", _label(), F.concat(F.lit("category="), "data_category", F.lit(", type="), "data_type"))

    def undescribed_columns(self) -> DataFrame:
        return _share_rule(self.user(self.estate.columns), COLUMN_DESCRIPTION_SHARE, "low", "A15", _label())

    def undescribed_model(self) -> DataFrame:
        bare = self.estate.models.where(~text.non_empty(F.coalesce("description", F.lit(""))))
        return _rows(bare, "low", "A16", F.col("model_id"), F.lit(""))

    def unformatted(self) -> DataFrame:
        return _rows(numeric_without_format(self.user(self.estate.columns)), "low", "A17", _label(), F.col("data_type"))

    def proxies(self) -> DataFrame:
        found = self.user(refs.external_proxies(self.estate.measures, self.estate.expressions))
        return _rows(found, "info", "A18", _label(), F.concat("external_model", F.lit("["), "remote_name", F.lit("]")))

    def field_parameters(self) -> DataFrame:
        hit = self.summary.where((F.col("origin") == "user") & (F.col("parameter_kind") == "field"))
        return _rows(hit, "info", "A19", F.col("table_name"), F.lit(""))

    def composite_proxies(self) -> DataFrame:
        hit = self.summary.where((F.col("origin") == "user") & (F.col("parameter_kind") == "compositeModelProxy"))
        return _rows(hit, "info", "A20", F.col("table_name"), F.col("remote_expression"))

    def _utilisation(self, statuses: DataFrame, share: float, check: str) -> DataFrame:
        counts = self.user(statuses).groupBy("model_id").agg(
            F.count_if(F.col("status") == "direct").alias("_d"), F.count(F.lit(1)).alias("_n")
        )
        percent = F.floor(F.col("_d") * 100 / F.col("_n") + 0.5).cast("string")
        return _rows(counts.where(F.col("_d") >= F.col("_n") * share), "good", check, F.col("model_id"), percent)

    def measure_utilisation(self) -> DataFrame:
        return self._utilisation(self.measure_status, MEASURE_UTILISATION, "A21")

    def column_utilisation(self) -> DataFrame:
        return self._utilisation(self.column_status, COLUMN_UTILISATION, "A22")

    def cycle_free(self) -> DataFrame:
        counts = self.user(self.estate.measures).groupBy("model_id").agg(F.count(F.lit(1)).alias("_n"))
        many = counts.where(F.col("_n") > CYCLE_FREE_MIN_MEASURES)
        return _rows(many.join(self.cycles.select("model_id").distinct(), "model_id", "left_anti"), "good", "A23", F.col("model_id"), F.lit(""))

    def calc_groups(self) -> DataFrame:
        groups = self.estate.calc_items.select("model_id", "group_name").distinct()
        return _rows(groups, "good", "A24", F.col("group_name"), F.lit(""))

    RULES = {
        "A1": auto_date, "A2": circular, "A3": broken, "A4": calculated_direct, "A5": unused_measures, "A6": dead_chain,
        "A7": unused_columns, "A8": dead_relationships, "A9": undescribed_tables, "A10": undescribed_measures,
        "A11": long_expressions, "A12": duplicates, "A13": empty_pages, "A14": url_categories, "A15": undescribed_columns,
        "A16": undescribed_model, "A17": unformatted, "A18": proxies, "A19": field_parameters, "A20": composite_proxies,
        "A21": measure_utilisation, "A22": column_utilisation, "A23": cycle_free, "A24": calc_groups,
    }

    def findings(self, *checks: str) -> DataFrame:
        chosen = checks or tuple(self.RULES)
        merged = self.RULES[chosen[0]](self)
        for check in chosen[1:]:
            merged = merged.unionByName(self.RULES[check](self))
        return merged


def severity_summary(findings: DataFrame) -> DataFrame:
    """Checks that fired and rows per severity, with the display order; ``is_clean`` marks models with no issue tier."""
    fired = findings.groupBy("model_id", "severity", "check_id").agg(F.count(F.lit(1)).alias("_rows"))
    counts = fired.groupBy("model_id", "severity").agg(F.count(F.lit(1)).alias("checks"), F.sum("_rows").alias("rows"))
    issues = F.max(F.col("severity").isin("high", "medium", "low"))
    clean = fired.groupBy("model_id").agg((~issues).alias("is_clean"))
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for n, s in enumerate(SEVERITIES)])
    return counts.join(clean, "model_id").withColumn("severity_order", rank)


def shown_findings(findings: DataFrame) -> DataFrame:
    """The rows a report lists per check, with how many more there are."""
    from pyspark.sql import Window

    cap = F.coalesce(*[F.when(F.col("check_id") == c, n) for c, n in SHOWN_ITEMS.items()], F.lit(DEFAULT_SHOWN))
    group = ["model_id", "check_id"]
    most = max(SHOWN_ITEMS.values())
    ranked = findings.withColumn("item_no", F.row_number().over(Window.partitionBy(*group).orderBy("entity", "detail")))
    shown = ranked.where(F.col("item_no") <= most).where(F.col("item_no") <= cap)
    sizes = findings.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return shown.join(sizes, group).withColumn("more", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_n")


def grouped_broken(broken: DataFrame) -> DataFrame:
    """Broken references per expression: how many, and by reason."""
    return broken.groupBy("model_id", "where").agg(
        F.count(F.lit(1)).alias("broken_refs"), F.count_if(F.col("reason") == "table not in model").alias("missing_tables"),
        F.count_if(F.col("reason") == "column not on table").alias("missing_columns"),
        F.count_if(F.col("reason") == "measure/column not found").alias("missing_names"),
        F.array_join(F.array_sort(F.collect_list(F.concat("broken", F.lit(" ("), "reason", F.lit(")")))), ", ").alias("refs"),
    )
