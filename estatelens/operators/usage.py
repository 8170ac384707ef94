"""Who uses what: deduplicated bindings, usage counts, direct / indirect / unused classification, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import patterns as P
from estatelens.operators import graph, refs
from estatelens.session import checkpoint


def field_kind() -> Column:
    return F.when(F.col("field_type") == "measure", "measure").otherwise("column")


def binding_order() -> Column:
    """Which binding of a field stands for a visual: filter roles last, then by sequence, none at the end; below 2**62."""
    is_filter = F.coalesce(F.col("role") == "Filter", F.lit(False)).cast("long")
    return is_filter * F.lit(1 << 61) + F.coalesce("seq", F.lit((1 << 61) - 1))


def deduped_bindings(bindings: DataFrame) -> DataFrame:
    """One binding per (field, page, visual): the first non-filter role, else the first binding.

    One ordered minimum, which combines before its only shuffle, so a hot field never fills one task; of those that tie (references below one
    object of a visual share their sequence) the smallest by role, field type, visual type and title stands.  Null keys are equal to each other.
    """
    keys = ["model_id", "kind", "table_name", "field_name", "page_id", "visual_id"]
    rest = ["seq", "role", "field_type", "visual_type", "title"]
    keyed = bindings.withColumn("kind", field_kind())
    one = keyed.groupBy(*keys).agg(F.min(F.struct(binding_order().alias("_order"), *rest)).alias("_b"))
    return one.select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def with_page_names(bindings: DataFrame, pages: DataFrame) -> DataFrame:
    """Add the display name of the page; an unknown page keeps its id."""
    names = pages.select("model_id", "page_id", F.col("name").alias("page_name"))
    return bindings.join(names, ["model_id", "page_id"], "left").withColumn("page_name", F.coalesce("page_name", "page_id"))


def field_usage(bindings: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Visuals and pages per bound field.  ``page_key="page_name"`` counts display names (see with_page_names).

    The binding that stands for a visual decides whether the field is a slicer field.  Its order and the flag, in the lowest bit, are one number,
    whose minimum is a hash aggregate.
    """
    is_slicer = F.coalesce(F.col("visual_type").isin(P.SLICER_TYPES), F.lit(False)).cast("long")
    packed = binding_order() * 2 + is_slicer
    keys = ["model_id", field_kind().alias("kind"), "table_name", "field_name", "page_id", "visual_id"]
    if page_key != "page_id":
        keys.append(page_key)
    visuals = bindings.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return visuals.groupBy("model_id", "kind", "table_name", "field_name").agg(
        F.count(F.lit(1)).alias("usage_count"), F.countDistinct(page_key).alias("page_count"),
        F.bool_or(F.col("_first") % 2 == 1).alias("is_slicer_field"),
    )


def with_usage(fields: DataFrame, usage: DataFrame, kind: str) -> DataFrame:
    """Fields with their usage counts, zero when unbound."""
    side = usage.where(F.col("kind") == kind).drop("kind").withColumnRenamed("field_name", "name")
    joined = fields.join(side, ["model_id", "table_name", "name"], "left")
    return joined.withColumns({
        "usage_count": F.coalesce("usage_count", F.lit(0).cast("long")),
        "page_count": F.coalesce("page_count", F.lit(0).cast("long")),
        "is_slicer_field": F.coalesce("is_slicer_field", F.lit(False)),
    })


def measure_status(estate: Estate, mode: str = "strict", edges: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """``(model_id, table_name, name, usage_count, page_count, status)`` for every measure."""
    edges = refs.dependencies(estate.measures, mode) if edges is None else edges
    usage = field_usage(estate.bindings) if usage is None else usage
    # One row per measure: written once, so the bindings are not counted again for the seeds and for the result.  Of usage that is not written yet only
    # what binds measures is counted.
    counted = checkpoint(with_usage(estate.measures.select("model_id", "table_name", "name"), usage, "measure").drop("is_slicer_field"))
    seeds = counted.where(F.col("usage_count") > 0).select("model_id", F.col("name").alias("node"))
    reached = graph.reach(edges, seeds).select("model_id", F.col("node").alias("name"), F.lit(True).alias("_reached"))
    status = F.when(F.col("usage_count") > 0, "direct").when(F.col("_reached"), "indirect").otherwise("unused")
    return counted.join(reached, ["model_id", "name"], "left").withColumn("status", status).select(
        "model_id", "table_name", "name", "usage_count", "page_count", "status"
    )


def relationship_columns(relationships: DataFrame) -> DataFrame:
    """Columns at either end of a relationship."""
    return (
        relationships.select("model_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("name"))
        .union(relationships.select("model_id", "to_table", "to_column"))
        .distinct()
    )


def referenced_columns(estate: Estate, statuses: DataFrame, mode: str = "compat") -> DataFrame:
    """Columns named in the text of a measure that is itself used."""
    used = statuses.where(F.col("status") != "unused").select("model_id", "table_name", "name")
    source, keys = estate.measures.select("model_id", "table_name", "name", "body"), ["model_id", "table_name", "name"]
    named = estate.columns.select("model_id", "table_name", "name")
    # Tokens first: bodies never go through a shuffle.  Written, as the filters Spark makes for the joins would read every body again.
    if mode == "strict":
        live = checkpoint(refs.qualified_refs(source)).join(used, keys, "left_semi")
        found = live.select("model_id", F.col("ref_table").alias("table_name"), F.col("ref_column").alias("name"))
        return named.join(found.distinct(), keys, "left_semi")
    live = checkpoint(refs.raw_tokens(source)).join(used, keys, "left_semi")
    found = live.select("model_id", F.col("ref_name").alias("name"))
    return named.join(found.distinct(), ["model_id", "name"], "left_semi").select("model_id", "table_name", "name")


def column_status(
    estate: Estate, statuses: DataFrame, mode: str = "compat", usage: DataFrame | None = None
) -> DataFrame:
    """``(model_id, table_name, name, usage_count, page_count, is_slicer_field, status)`` for every column."""
    usage = field_usage(estate.bindings) if usage is None else usage
    counted = with_usage(estate.columns.select("model_id", "table_name", "name"), usage, "column")
    indirect = relationship_columns(estate.relationships).union(referenced_columns(estate, statuses, mode)).distinct()
    joined = counted.join(indirect.withColumn("_indirect", F.lit(True)), ["model_id", "table_name", "name"], "left")
    status = F.when(F.col("usage_count") > 0, "direct").when(F.col("_indirect"), "indirect").otherwise("unused")
    return joined.withColumn("status", status).drop("_indirect")


def orphans(statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """Unused measures split into ``pure`` (nothing depends on them) and ``chain`` (only dead measures do)."""
    needed = edges.select("model_id", F.col("dst").alias("name")).distinct().withColumn("_needed", F.lit(True))
    unused = statuses.where(F.col("status") == "unused").select("model_id", "table_name", "name")
    split = F.when(F.col("_needed"), "chain").otherwise("pure")
    return unused.join(needed, ["model_id", "name"], "left").select("model_id", "table_name", "name", split.alias("orphan"))


def status_by_table(statuses: DataFrame) -> DataFrame:
    """Measures per home table and status."""
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("direct", "indirect", "unused")}
    return statuses.groupBy("model_id", "table_name").agg(F.count(F.lit(1)).alias("total"), *counts.values())


def totals(estate: Estate, measures: DataFrame, columns: DataFrame) -> DataFrame:
    """The fourteen headline counts of each model, one row per model.

    Every count comes from its own partial aggregate; the rows that meet in the final group are one per input.
    """

    def counts(df: DataFrame, total: str, prefix: str | None = None) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias(total)]
        if prefix:
            aggs += [F.count_if(F.col("status") == s).alias(f"{prefix}_{s}") for s in ("direct", "indirect", "unused")]
        return df.groupBy("model_id").agg(*aggs)

    groups = estate.calc_items.select("model_id", "group_name").distinct()
    parts = [
        counts(measures, "measures", "measures"), counts(columns, "columns", "columns"),
        counts(estate.relationships, "relationships"), counts(estate.functions, "functions"), counts(groups, "calc_groups"),
        counts(refs.table_names(estate.columns, estate.measures, estate.calc_items), "tables"),
        counts(estate.pages, "pages"), counts(estate.visuals, "visuals"),
    ]
    names = [c for part in parts for c in part.columns if c != "model_id"]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.groupBy("model_id").agg(*[F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in names])
