"""Pages and visuals: categories, per-page counts, field wells, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import patterns as P
from estatelens.functions import text
from estatelens.operators import usage


def visual_category(visual_type: Column) -> Column:
    """Category of a data visual; null for shapes, buttons, images and text."""
    kind = F.lower(visual_type)
    chain = F.when(kind.isin(P.VISUAL_CATEGORIES[0][1]), P.VISUAL_CATEGORIES[0][0])
    for name, types in P.VISUAL_CATEGORIES[1:]:
        hit = kind.isin(types) | kind.contains("chart") if name == "chart" else kind.isin(types)
        chain = chain.when(hit, name)
    return chain


def known_fields(estate: Estate) -> DataFrame:
    """``(model_id, kind, table_name, field_name)`` of every measure and column."""
    return estate.measures.select("model_id", F.lit("measure").alias("kind"), "table_name", F.col("name").alias("field_name")).union(
        estate.columns.select("model_id", F.lit("column"), "table_name", "name")
    )


def known_bindings(estate: Estate) -> DataFrame:
    """Deduplicated bindings of fields the model has."""
    return usage.deduped_bindings(estate.bindings).join(known_fields(estate), ["model_id", "kind", "table_name", "field_name"], "left_semi")


def bound_visuals(bindings: DataFrame, mode: str = "strict") -> DataFrame:
    """Distinct (page, visual, type).  ``compat`` takes visuals of one title (or type) on a page for one visual."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("visual_type"))
    key = F.col("visual_id") if mode == "strict" else titled
    return bindings.groupBy("model_id", "page_id", key.alias("visual_key")).agg(F.min_by("visual_type", "seq").alias("visual_type"))


def page_summary(estate: Estate, mode: str = "strict") -> DataFrame:
    """One row per page, bound or not: visuals, distinct measures and columns, slicers, coverage percent."""
    bound = known_bindings(estate)
    # Distinct first: one shuffle by the full key spreads a hot page, and the counts after it combine map-side.
    names = bound.select("model_id", "page_id", "kind", "field_name").distinct().groupBy("model_id", "page_id").agg(
        F.count_if(F.col("kind") == "measure").alias("measure_count"), F.count_if(F.col("kind") == "column").alias("column_count")
    )
    slicers = bound_visuals(bound, mode).groupBy("model_id", "page_id").agg(
        F.count_if(F.col("visual_type") == "slicer").alias("slicer_count")
    )
    visuals = estate.visuals.groupBy("model_id", "page_id").agg(F.count(F.lit(1)).alias("visual_count"))
    total = estate.measures.groupBy("model_id").agg(F.count(F.lit(1)).alias("_total"))
    keys = ["model_id", "page_id"]
    joined = estate.pages.join(visuals, keys, "left").join(names, keys, "left").join(slicers, keys, "left").join(total, "model_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long"))

    share = F.floor(zero("measure_count") * 100 / F.col("_total") + 0.5).cast("long")
    return joined.select(
        *keys, "name", "hidden", "width", "height", *[zero(c).alias(c) for c in ("visual_count", "measure_count", "column_count", "slicer_count")],
        F.coalesce(share, F.lit(0).cast("long")).alias("coverage"),
    )


def type_counts(estate: Estate, mode: str = "strict") -> DataFrame:
    """Bound visuals per page and type (long form)."""
    return bound_visuals(known_bindings(estate), mode).groupBy("model_id", "page_id", "visual_type").agg(F.count(F.lit(1)).alias("visuals"))


def field_wells(estate: Estate) -> DataFrame:
    """Data visuals with the fields in their wells, filters left out: one row per visual and field, none kept as null."""
    shown = estate.visuals.withColumn("category", visual_category(F.col("visual_type"))).where(F.col("category").isNotNull())
    fields = estate.bindings.where(F.col("role") != "Filter").select("model_id", "page_id", "visual_id", "role", "table_name", "field_name")
    return shown.select("model_id", "page_id", "visual_id", "category", "z").join(fields, ["model_id", "page_id", "visual_id"], "left")


def z_order(visuals: DataFrame) -> DataFrame:
    """Data visuals of every page numbered from back to front."""
    from estatelens.operators.numbering import number_rows

    shown = visuals.withColumn("category", visual_category(F.col("visual_type"))).where(F.col("category").isNotNull())
    return number_rows(shown, ["model_id", "page_id"], [F.col("z").asc(), F.col("visual_id").asc()], "z_no")


def page_order(summary: DataFrame) -> list[Column]:
    bound = F.col("measure_count") + F.col("column_count")
    return [F.col("hidden").asc(), F.when(F.col("hidden"), 0).otherwise(-bound).asc(),
            F.when(F.col("hidden"), 0).otherwise(-F.col("visual_count")).asc(), F.col("name").asc(), F.col("page_id").asc()]


def page_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("hidden")).alias("visible"), F.count_if("hidden").alias("hidden_pages"),
        F.sum("visual_count").alias("visuals"),
    )


def display_names(pages: DataFrame) -> DataFrame:
    """Page names with collapsed blanks, and whether another page of the model has the same one."""
    named = pages.select("model_id", "page_id", text.page_display_name(F.col("name")).alias("display_name"))
    counts = named.groupBy("model_id", "display_name").agg(F.count(F.lit(1)).alias("_n"))
    return named.join(counts, ["model_id", "display_name"]).select(
        "model_id", "page_id", "display_name", (F.col("_n") > 1).alias("is_duplicate")
    )


def empty_visible_pages(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("measure_count") == 0) & (F.col("column_count") == 0) & ~F.col("hidden"))
