"""Partitions and their sources: resolved bodies, steps, physical-source index, source map, cohorts, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import etl, text
from estatelens.functions import patterns as P
from estatelens.operators import graph, refs, roles
from estatelens.operators.numbering import first_per_group, number_rows, preview
from estatelens.operators.pages import known_fields
from estatelens.operators.usage import field_kind
from estatelens.session import checkpoint

KEYS = ["model_id", "table_name", "part_no"]


def resolve_partitions(partitions: DataFrame, expressions: DataFrame) -> DataFrame:
    """Partitions whose body is the shared expression they name, when the model has it.

    Only partitions that name one are joined; all others, a single hot key otherwise, pass without a shuffle.
    """
    shared = expressions.select("model_id", F.col("name").alias("expression_source"), F.col("value").alias("_value"))
    naming = F.coalesce("expression_source", F.lit("")) != ""
    joined = partitions.where(naming).join(shared, ["model_id", "expression_source"], "left")
    body = F.when(F.coalesce("_value", F.lit("")) != "", F.col("_value")).otherwise(F.col("m_body"))
    return joined.withColumn("m_body", body).select(*partitions.columns).unionByName(partitions.where(~naming))


def inferred_sources(resolved: DataFrame) -> DataFrame:
    """Partitions with source type, location, native query and physical source."""
    lowered = resolved.withColumn("_lower", F.lower("m_body"))
    body = F.col("m_body")
    return lowered.select(
        *KEYS, "name", "mode", "kind", "expression_source", etl.source_type(body, F.col("_lower")).alias("source_type"),
        etl.source_location(body).alias("source_location"), etl.native_query(body).alias("native_query"),
        etl.physical_source(body).alias("source"),
    )


def steps(resolved: DataFrame) -> DataFrame:
    """One row per top-level step of a body, in order."""
    exploded = resolved.select(*KEYS, F.posexplode(etl.statements(F.col("m_body"))).alias("_pos", "_s"))
    kinds = exploded.select(*KEYS, (F.col("_pos") + 1).alias("step_no"), F.col("_s.name").alias("name"), F.col("_s.text").alias("text"))
    kinds = kinds.withColumns({"kind": etl.step_kind(F.col("text")), "primary_fn": etl.step_function(F.col("text"))})
    return kinds.withColumn("summary", etl.step_summary(F.col("text"), F.col("kind"))).drop("text")


def step_signatures(resolved: DataFrame) -> DataFrame:
    """The step shape of each partition, ``kind:function`` joined by bars; computed inside the row, no shuffle."""
    shape = F.transform(
        etl.statements(F.col("m_body")), lambda s: F.concat(etl.step_kind(s["text"]), F.lit(":"), etl.step_function(s["text"]))
    )
    return resolved.select(*KEYS, F.array_join(shape, "|").alias("signature")).where(F.col("signature") != "")


def step_cohorts(signatures: DataFrame, minimum: int = P.COHORT_MIN_MEMBERS) -> DataFrame:
    """Shapes at least ``minimum`` partitions share."""
    counts = signatures.groupBy("model_id", "signature").agg(F.count(F.lit(1)).alias("members"))
    return counts.where(F.col("members") >= minimum)


def regular_tables(summary: DataFrame) -> DataFrame:
    """User tables that are neither parameters, proxies nor calculation groups."""
    return summary.where((F.col("origin") == "user") & F.col("parameter_kind").isNull() & ~F.col("is_calc_group"))


def table_bindings(estate: Estate) -> DataFrame:
    """Distinct (table, page, visual) over the bindings of each table's known columns and measures.

    Bindings shrink to their distinct keys before anything is joined or picked among them.
    """
    keys = estate.bindings.select("model_id", field_kind().alias("kind"), "table_name", "field_name", "page_id", "visual_id").distinct()
    known = keys.join(known_fields(estate), ["model_id", "kind", "table_name", "field_name"], "left_semi")
    return known.select("model_id", "table_name", "page_id", "visual_id").distinct()


def source_tables(sources: DataFrame) -> DataFrame:
    """Distinct (source key, table)."""
    known = sources.where(F.col("source").isNotNull())
    return known.select("model_id", etl.source_key(F.col("source")).alias("source_key"), "source.*", "table_name").distinct()


def source_index(estate: Estate, sources: DataFrame) -> DataFrame:
    """One row per physical source: how many tables read it, and the visuals and pages that break without it."""
    tables = source_tables(sources)
    touched = tables.select("model_id", "source_key", "table_name").join(table_bindings(estate), ["model_id", "table_name"])
    # Two distinct counts, each two-phase: a source holding a third of all bindings is counted in parallel.
    visuals = touched.select("model_id", "source_key", "page_id", "visual_id").distinct()
    per_page = visuals.groupBy("model_id", "source_key", "page_id").agg(F.count(F.lit(1)).alias("n"))
    usage_counts = per_page.groupBy("model_id", "source_key").agg(F.sum("n").alias("visual_count"), F.count(F.lit(1)).alias("page_count"))
    parts = ["kind", "server", "database", "schema", "name"]
    keys = tables.groupBy("model_id", "source_key", *parts).agg(F.count(F.lit(1)).alias("table_count"))
    listed = preview(tables, ["model_id", "source_key"], "table_name", "table").drop("table_count")
    joined = keys.join(listed, ["model_id", "source_key"]).join(usage_counts, ["model_id", "source_key"], "left")
    zero = F.lit(0).cast("long")
    return joined.withColumns({"visual_count": F.coalesce("visual_count", zero), "page_count": F.coalesce("page_count", zero)})


def source_index_order() -> list[Column]:
    return [F.col("visual_count").desc(), F.col("table_count").desc(), F.col("source_key").asc()]


def source_impact(estate: Estate, sources: DataFrame) -> DataFrame:
    """What breaks with each source, by table: its measures and columns, and the visuals and pages that show them."""
    zero = F.lit(0).cast("long")
    keys = ["model_id", "table_name"]
    shown = table_bindings(estate).groupBy(*keys, "page_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("visuals"), F.count(F.lit(1)).alias("pages")
    )
    measures = estate.measures.groupBy(*keys).agg(F.count(F.lit(1)).alias("measures"))
    columns = estate.columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("columns"))
    joined = source_tables(sources).select("model_id", "source_key", "table_name")
    for side in (measures, columns, shown):
        joined = joined.join(side, keys, "left")
    return joined.select("model_id", "source_key", "table_name", *[F.coalesce(c, zero).alias(c) for c in ("measures", "columns", "visuals", "pages")])


def transitive_impact(estate: Estate, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Per physical source everything that breaks without it: tables, measures on them or naming their columns, measures of those measures
    at any depth, and the visuals and pages that show any of these measures or a column of the tables.

    Sources are numbered and travel as bits, so no (source, measure) pairs are formed: a measure, a visual or a page holds one number
    for 64 sources.
    """
    tables = checkpoint(source_tables(sources).select("model_id", "source_key", "table_name").distinct())
    # Sources of the same or neighbouring tables break much the same things: next to each other they share a word; those of many tables have words of their own.
    placing = tables.groupBy("model_id", "source_key").agg((F.count(F.lit(1)) > 1).alias("_wide"), F.min("table_name").alias("_table"))
    numbered = number_rows(placing, ["model_id"], [F.col("_wide").desc(), F.col("_table"), F.col("source_key")], "_no")
    numbered = checkpoint(numbered.select("model_id", "source_key", (F.col("_no") - 1).alias("mark")))
    bit = F.expr("shiftleft(1L, cast(mark % 64 as int)) as bits")
    either = F.bit_or("bits").alias("bits")
    placed = tables.join(numbered, ["model_id", "source_key"]).select("model_id", "table_name", F.floor(F.col("mark") / 64).alias("word"), bit)
    on_tables = checkpoint(placed.groupBy("model_id", "table_name", "word").agg(either))
    homes = estate.measures.select("model_id", "table_name", F.col("name").alias("node"))
    named = refs.qualified_refs(estate.measures.select("model_id", F.col("name").alias("node"), "body"))
    touching = homes.unionByName(named.select("model_id", F.col("ref_table").alias("table_name"), "node")).distinct()
    seeds = checkpoint(touching.join(on_tables, ["model_id", "table_name"]).groupBy("model_id", "node", "word").agg(either))
    reached = graph.spread(edges, seeds)
    keys = estate.bindings.select("model_id", field_kind().alias("kind"), "table_name", "field_name", "page_id", "visual_id").distinct()
    known = checkpoint(keys.join(known_fields(estate), ["model_id", "kind", "table_name", "field_name"], "left_semi"))
    shown, place = ["model_id", "page_id", "visual_id"], ["model_id", "page_id", "visual_id", "word"]
    by_measure = known.where("kind = 'measure'").select(*shown, F.col("field_name").alias("node")).distinct().join(reached, ["model_id", "node"])
    by_column = known.where("kind = 'column'").select(*shown, "table_name").distinct().join(on_tables, ["model_id", "table_name"])
    visuals = checkpoint(by_measure.select(*place, "bits").unionByName(by_column.select(*place, "bits")).groupBy(*place).agg(either))
    pages = visuals.groupBy("model_id", "page_id", "word").agg(either)
    out = numbered.join(tables.groupBy("model_id", "source_key").agg(F.count(F.lit(1)).alias("tables")), ["model_id", "source_key"])
    sides = {"direct_measures": seeds, "measures": reached, "visuals": visuals, "pages": pages}
    for name, words in sides.items():
        out = out.join(graph.marked(words, name), ["model_id", "mark"], "left")
    zero = F.lit(0).cast("long")
    return out.select("model_id", "source_key", "tables", *[F.coalesce(name, zero).alias(name) for name in sides])


def source_map(estate: Estate, sources: DataFrame, summary: DataFrame) -> DataFrame:
    """Per column of a user table the mode, type and location of its table's first partition."""
    first = first_per_group(
        sources.select(*KEYS, "mode", "source_type", "source_location"), ["model_id", "table_name"], [F.col("part_no")]
    ).drop("part_no")
    tables = summary.where(F.col("origin") == "user").select("model_id", "table_name", F.col("is_calculated").alias("_calc"))
    columns = roles.without_calc_names(estate.columns, estate.calc_items).select(
        "model_id", "table_name", F.col("name").alias("column"), "data_type", "is_calculated", "is_hidden"
    )
    table_side = tables.join(first, ["model_id", "table_name"], "left")
    absent = F.col("source_type").isNull()
    joined = columns.join(table_side, ["model_id", "table_name"])
    return joined.select(
        "model_id", "column", "table_name", "data_type",
        F.when(~absent, F.col("mode")).when(F.col("_calc"), "calculated").otherwise("—").alias("mode"),
        F.when(~absent, F.col("source_type")).when(F.col("_calc"), "Calculated (DAX)").otherwise("—").alias("source_type"),
        F.coalesce("source_location", F.lit("")).alias("source_location"), "is_hidden", "is_calculated",
    )


def source_bucket(source_type: Column, location: Column) -> Column:
    """Grouping key of a table's source: the server of remote cubes, the folder of files, else type and location."""
    slashed = F.replace(location, F.lit("\\"), F.lit("/"))
    folder = F.when(slashed.contains("/"), F.regexp_extract(location, r"(?s)^(.*)[/\\][^/\\]*\z", 1)).otherwise(F.lit(""))
    in_folder = F.when(folder != "", F.concat_ws("|", source_type, folder)).otherwise(F.concat(source_type, F.lit("|__all__")))
    return (
        F.when(source_type.isNull(), "__nosrc__").when(source_type == "Analysis Services", F.concat(F.lit("AS:"), location))
        .when(source_type.isin(P.FILE_SOURCE_TYPES), in_folder).otherwise(F.concat_ws("|", source_type, location))
    )


def source_buckets(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """Regular tables per source bucket of their first partition."""
    first = first_per_group(sources.select(*KEYS, "source_type", "source_location"), ["model_id", "table_name"], [F.col("part_no")])
    tables = regular_tables(summary).select("model_id", "table_name").join(first, ["model_id", "table_name"], "left")
    bucket = source_bucket(F.col("source_type"), F.col("source_location"))
    return tables.groupBy("model_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tables"))


def mode_counts(partitions: DataFrame, summary: DataFrame, lowercase: bool) -> DataFrame:
    """Partitions per storage mode; the model report folds case and counts every table, the source report keeps case
    and counts user tables."""
    if lowercase:
        mode = F.lower(F.when(F.col("mode") == "", "import").otherwise(F.col("mode")))
        return partitions.groupBy("model_id", mode.alias("mode")).agg(F.count(F.lit(1)).alias("partitions"))
    user = summary.where(F.col("origin") == "user").select("model_id", "table_name")
    mode = F.when(F.col("mode") == "", "unknown").otherwise(F.col("mode"))
    return partitions.join(user, ["model_id", "table_name"], "left_semi").groupBy("model_id", mode.alias("mode")).agg(
        F.count(F.lit(1)).alias("partitions")
    )


def remote_model(expression: Column) -> Column:
    """Name of the remote model an expression stands for."""
    named = F.regexp_extract(expression, f"^{P.REMOTE_PREFIX}(.+)$", 1)
    return F.when(named != "", named).when(F.coalesce(expression, F.lit("")) != "", expression).otherwise("Unknown")


def proxy_tables(summary: DataFrame) -> DataFrame:
    """Proxy tables with the remote model they stand for."""
    proxies = summary.where((F.col("origin") == "user") & (F.col("parameter_kind") == "compositeModelProxy"))
    return proxies.select("model_id", "table_name", remote_model(F.col("remote_expression")).alias("remote_model"))


def raw_bodies(resolved: DataFrame) -> DataFrame:
    return resolved.select(*KEYS, text.capped_body(F.col("m_body")).alias("body")).where(F.col("body") != "")
