"""One-hop lineage as typed edges, search, and the filters of the lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.operators import refs, usage

SEARCH_LIMIT = 12


def lineage_edges(estate: Estate, mode: str = "strict", edges: DataFrame | None = None) -> DataFrame:
    """``(model_id, entity_kind, entity, direction, related_kind, related)`` for every measure and column.

    Entities are ``table[name]``; filter on one to see its neighbourhood, or keep the whole table as the estate's map.
    """
    edges = refs.dependencies(estate.measures, mode) if edges is None else edges
    full = F.concat("table_name", F.lit("["), "name", F.lit("]"))
    names = estate.measures.select("model_id", "name", full.alias("label"), "table_name")

    def rows(df: DataFrame, kind: str, entity: Column, direction: str, related_kind: str, related: Column) -> DataFrame:
        return df.select(
            "model_id", F.lit(kind).alias("entity_kind"), entity.alias("entity"), F.lit(direction).alias("direction"),
            F.lit(related_kind).alias("related_kind"), related.alias("related"),
        )

    a, b = names.select("model_id", F.col("name").alias("src"), F.col("label").alias("_src")), names.select(
        "model_id", F.col("name").alias("dst"), F.col("label").alias("_dst")
    )
    labelled = edges.join(a, ["model_id", "src"]).join(b, ["model_id", "dst"])
    calls = refs.function_uses(refs.without_about(estate.functions), estate.measures)
    caller = F.concat("table_name", F.lit("["), "measure", F.lit("]"))
    remote = refs.external_proxies(estate.measures, estate.expressions)
    bound = usage.deduped_bindings(estate.bindings)
    field = F.concat("table_name", F.lit("["), "field_name", F.lit("]"))
    known = names.select("model_id", F.lit("measure").alias("kind"), F.col("label").alias("entity")).union(
        estate.columns.select("model_id", F.lit("column"), full)
    )
    visuals = bound.select("model_id", "kind", field.alias("entity"), F.concat_ws("/", "page_id", "visual_id").alias("related")).join(
        known, ["model_id", "kind", "entity"], "left_semi"
    )
    readers = refs.column_refs(estate.measures, estate.columns)
    column = F.concat("table_name", F.lit("["), "column", F.lit("]"))
    reader = F.concat("measure_table", F.lit("["), "measure", F.lit("]"))
    parts = [
        rows(calls, "measure", caller, "upstream", "function", F.col("function")),
        rows(remote, "measure", full, "upstream", "remote model", F.col("external_model")),
        rows(names, "measure", F.col("label"), "upstream", "table", F.col("table_name")),
        rows(labelled, "measure", F.col("_src"), "upstream", "measure", F.col("_dst")),
        rows(labelled, "measure", F.col("_dst"), "feeds", "measure", F.col("_src")),
        rows(estate.columns, "column", full, "upstream", "table", F.col("table_name")),
        rows(readers, "column", column, "feeds", "measure", reader),
        visuals.select(
            "model_id", F.col("kind").alias("entity_kind"), "entity", F.lit("downstream").alias("direction"),
            F.lit("visual").alias("related_kind"), "related",
        ),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def searchable(measures: DataFrame, columns: DataFrame) -> DataFrame:
    keep = ["model_id", "table_name", "name", "status"]
    return measures.select(F.lit("measure").alias("kind"), *keep).unionByName(columns.select(F.lit("column").alias("kind"), *keep))


def search_hits(fields: DataFrame, query: str) -> DataFrame:
    """Fields whose name holds ``query``, with ``match``: 0 exact, 1 prefix, 2 inside; case does not matter."""
    q, name = query.lower().strip(), F.lower("name")
    match = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    return fields.where(name.contains(q)).withColumn("match", match)


def search(fields: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The best ``limit`` hits: exact, then prefix, then inside; measures before columns, then by name."""
    order = [F.col("match"), (F.col("kind") != "measure"), F.col("name"), F.col("table_name")]
    return search_hits(fields, query).orderBy(*order).limit(limit)


def matching(df: DataFrame, query: str, *names: str) -> DataFrame:
    """Rows where any of the named columns holds ``query``, whatever the case."""
    q = query.lower()
    hit = F.lit(False)
    for name in names:
        hit = hit | F.lower(F.coalesce(name, F.lit(""))).contains(q)
    return df.where(hit)


def not_direct(df: DataFrame) -> DataFrame:
    """The on-screen "unused" filter: everything no visual binds."""
    return df.where(F.col("status") != "direct")


def unused_only(df: DataFrame) -> DataFrame:
    """The export's "unused" filter."""
    return df.where(F.col("status") == "unused")
