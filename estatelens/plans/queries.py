"""Registered queries: one per operator, over the estate derived from the tables in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import etl, text
from estatelens.functions import patterns as P
from estatelens.operators import audit as rules
from estatelens.operators import graph, impact, lineage, links, messages, pages, refs, roles, usage
from estatelens.operators.numbering import capped, first_per_group, number_rows
from estatelens.plans import documents, render, reports
from estatelens.session import checkpoint, checkpoint_folder, dealt, tune, written
from estatelens.sinks import csv, tables
from estatelens.sinks import markdown as md
from estatelens.sources import bim, blocks, files, project, report


class Context:
    """One call's inputs: the derived estate and the intermediate results several operators share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.e = e = Estate.derived(spark, sf_dir)
        # For queries that use a derived table several times: derived once and written, as a saved estate would be; measures in columns, as few read the bodies.
        self.s = e.replace(measures=lambda: written(e.measures), relationships=lambda: checkpoint(e.relationships))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def edges(self) -> DataFrame:
        return checkpoint(refs.dependencies(self.s.measures))

    @cached_property
    def usage(self) -> DataFrame:
        return checkpoint(usage.field_usage(self.e.bindings))

    @cached_property
    def column_usage(self) -> DataFrame:
        return checkpoint(usage.field_usage(self.e.bindings).where(F.col("kind") == "column"))

    @cached_property
    def mstatus(self) -> DataFrame:
        return usage.measure_status(self.s, "strict", self.edges, usage.field_usage(self.e.bindings))

    @cached_property
    def cstatus(self) -> DataFrame:
        return usage.column_status(self.s, checkpoint(self.mstatus), "compat", self.column_usage)

    @cached_property
    def summary(self) -> DataFrame:
        return roles.table_summary(self.s)

    @cached_property
    def resolved(self) -> DataFrame:
        return checkpoint(dealt(impact.resolve_partitions(self.e.partitions, self.e.expressions), *impact.KEYS))

    @cached_property
    def sources(self) -> DataFrame:
        return impact.inferred_sources(self.resolved)

    @cached_property
    def steps(self) -> DataFrame:
        return impact.steps(self.resolved)

    @cached_property
    def page_summary(self) -> DataFrame:
        return pages.page_summary(self.s)

    @cached_property
    def audit(self) -> rules.Audit:
        return rules.Audit(self.s)

    @cached_property
    def findings(self) -> DataFrame:
        return checkpoint(self.audit.findings())  # read twice by what follows

    @cached_property
    def linked(self) -> DataFrame:
        return checkpoint(documents.linked_documents(self.s, self.mstatus, self.summary))

    @cached_property
    def fields(self) -> DataFrame:
        return lineage.searchable(self.mstatus, self.cstatus)


QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
Q = QUERIES
col = F.col


def source_columns(df: DataFrame) -> DataFrame:
    return df.where(col("source").isNotNull()).select("model_id", "table_name", "part_no", "source.*")


def shape_only(c: Context, build: Callable) -> DataFrame:
    return source_columns(c.resolved.select(*impact.KEYS, build(col("m_body")).alias("source")))


# ---- S: sources (the derived estate written as project files and read back) --------------------------------------


def text_members(rendered: DataFrame) -> DataFrame:
    return blocks.members(blocks.table_sections(rendered))


def partition_texts(c: Context) -> DataFrame:
    return checkpoint(dealt(render.partition_files(c.e), "path"))


def scanned(c: Context, rendered: DataFrame, take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return report.on_listed_pages(take(report.parsed_visuals(rendered)), report.page_rows(render.page_files(c.e)))


BOUND = ["page_id", "visual_id", "visual_type", "title", "role", "field_type", "table_name", "field_name"]
Q["s02_roots"] = lambda c: files.roots(render.corpus_files(c.spark, c.sf_dir))
Q["s02_shallowest_reports"] = lambda c: files.shallowest_report(render.corpus_files(c.spark, c.sf_dir))
Q["s03_pairs_by_name"] = lambda c: files.pairs_by_name(render.corpus_files(c.spark, c.sf_dir))
Q["s03_reports_for_models"] = lambda c: files.reports_for_models(render.corpus_files(c.spark, c.sf_dir))
Q["s03_default_pairs"] = lambda c: files.default_pair(render.corpus_files(c.spark, c.sf_dir))
Q["s04_pairs_on_disk"] = lambda c: files.pairs_on_disk(render.corpus_files(c.spark, c.sf_dir))
Q["s05_load_modes"] = lambda c: files.projects(render.corpus_files(c.spark, c.sf_dir)).select("workspace", "report", "model", "mode")
Q["s06_pages"] = lambda c: report.page_rows(render.page_files(c.e).unionByName(render.visual_files(c.e))).drop("report", "page_no")
Q["s06_visuals"] = lambda c: scanned(c, render.visual_files(c.e), report.visual_rows).drop("report")
Q["s07_well_bindings"] = lambda c: scanned(c, render.binding_files(c.e), report.projection_bindings).select(BOUND)
Q["s08_filter_bindings"] = lambda c: scanned(c, render.binding_files(c.e), report.filter_bindings).select(BOUND)
Q["s09_formatting_bindings"] = lambda c: scanned(c, render.binding_files(c.e, formatting=True), report.formatting_bindings).select(BOUND)
Q["s10_field_references"] = lambda c: scanned(c, render.binding_files(c.e), report.binding_rows).groupBy("field_type", "table_name", "field_name").agg(
    F.count(F.lit(1)).alias("bindings")
)
Q["s11_json_columns"] = lambda c: bim.columns(bim.parsed(render.bim_files(c.e))).drop("root")
Q["s11_json_measures"] = lambda c: bim.measures(bim.parsed(render.bim_files(c.e))).drop("root")
Q["s11_json_partitions"] = lambda c: bim.partitions(bim.parsed(render.bim_files(c.e))).drop("root", "part_no")
Q["s11_json_relationships"] = lambda c: bim.relationships(bim.parsed(render.bim_files(c.e))).drop("root", "rel_no")
Q["s12_text_relationships"] = lambda c: blocks.relationships(render.relationship_files(c.e)).drop("root")
Q["s13_text_tables"] = lambda c: blocks.tables(blocks.table_sections(render.table_files(c.e))).select("table_name", "description")
Q["s13_text_columns"] = lambda c: blocks.columns(text_members(render.table_files(c.e))).drop("root")
Q["s13_text_measures"] = lambda c: blocks.measures(text_members(render.table_files(c.e))).drop("root")
Q["s13_text_calc_items"] = lambda c: blocks.calc_items(text_members(render.calc_item_files(c.e))).drop("root", "ordinal")
Q["s14_text_partitions"] = lambda c: blocks.partitions(text_members(partition_texts(c))).drop("root", "part_no")
Q["s15_text_hierarchies"] = lambda c: blocks.hierarchies(text_members(render.hierarchy_files(c.e))).drop("root")
Q["s16_text_expressions"] = lambda c: blocks.expressions(render.expression_files(c.e)).drop("root")
Q["s17_text_functions"] = lambda c: blocks.functions(render.function_files(c.e)).drop("root")
Q["s18_model_properties"] = lambda c: blocks.models(render.model_files(c.e)).select(
    "name", "description", "culture", F.array_join("cultures", ", ").alias("cultures"), "compatibility_level", "discourage_implicit", "value_filter"
)
Q["s19_formats"] = lambda c: project.formats(render.corpus_files(c.spark, c.sf_dir)).withColumnRenamed("root", "model")

# ---- X: text and scalar functions -------------------------------------------------------------------------------

Q["x01_strip_comments"] = lambda c: c.e.measures.select("name", text.strip_comments_and_strings(col("body")).alias("clean"))
Q["x02_qualified_refs"] = lambda c: refs.qualified_refs(c.e.measures.select("name", "body"))
Q["x03_bare_refs"] = lambda c: refs.bare_refs(c.e.measures.select("name", "body"))
Q["x04_compat_dependencies"] = lambda c: refs.dependencies(c.e.measures, "compat")
Q["x05_external_proxies"] = lambda c: refs.external_proxies(c.e.measures, c.e.expressions)
Q["x06_source_type"] = lambda c: c.sources.select("table_name", "part_no", "source_type", "source_location")
Q["x07_native_query"] = lambda c: c.sources.where(col("native_query") != "").select("table_name", "part_no", "native_query")
Q["x08_sql_source"] = lambda c: shape_only(c, etl.sql_source)
Q["x09_bigquery_source"] = lambda c: shape_only(c, etl.bigquery_source)
Q["x10_file_source"] = lambda c: shape_only(c, etl.file_source)
Q["x11_web_source"] = lambda c: shape_only(c, etl.web_source).unionByName(shape_only(c, etl.sharepoint_source))
Q["x11_url_parts"] = lambda c: c.table("pages").select("page_id", etl.url_host(col("url")).alias("host"), etl.url_path(col("url")).alias("path"))
Q["x12_physical_source"] = lambda c: source_columns(c.sources)
Q["x13_steps"] = lambda c: c.steps.select("table_name", "part_no", "step_no", "name")
Q["x14_step_kinds"] = lambda c: c.steps.select("table_name", "part_no", "step_no", "kind", "primary_fn")
Q["x15_step_summaries"] = lambda c: c.steps.select("table_name", "part_no", "step_no", "summary")


def indented(c: Context) -> DataFrame:
    body = F.concat(F.lit("\t\t"), F.replace("text", F.lit("\n"), F.lit("\n\t\t")), F.lit("\n"))
    return c.table("documents").select("doc_id", body.alias("body"))


Q["x16_capped_bodies"] = lambda c: indented(c).select("doc_id", text.capped_body(col("body")).alias("body"))
Q["x17_non_blank_lines"] = lambda c: c.table("documents").select("doc_id", text.non_blank_lines(col("text")).alias("lines"))
Q["x18_normalized_bodies"] = lambda c: c.table("documents").select("doc_id", text.normalized_body(col("text")).alias("body"))
Q["x19_parameters"] = lambda c: c.e.functions.select(
    "name", text.parameter_count(col("parameters")).alias("parameter_count"), F.posexplode(text.parameters(col("parameters"))).alias("p", "v")
).select("name", "parameter_count", (col("p") + 1).alias("param_no"), col("v.name").alias("param_name"), col("v.type").alias("param_type"))
Q["x20_slugs"] = lambda c: c.table("documents").select("doc_id", text.github_slug(col("text")).alias("github"), text.wiki_slug(col("text")).alias("wiki"))
Q["x21_letter_buckets"] = lambda c: c.table("documents").select(
    "doc_id", text.letter_bucket(col("text")).alias("trimmed"), text.letter_bucket(col("text"), trim=False).alias("untrimmed")
)
Q["x22_truncated"] = lambda c: c.table("documents").select(
    "doc_id", text.truncated(col("text"), 77, 80).alias("cut80"), text.truncated(col("text"), 97, 100).alias("cut100"),
    text.truncated(col("text"), 110, 110).alias("cut110"),
)
Q["x23_csv_fields"] = lambda c: c.e.measures.select("name", text.csv_field(col("body")).alias("body"), text.csv_field(col("description")).alias("description"))
Q["x24_page_names"] = lambda c: pages.display_names(c.e.pages)

# ---- P: projections and classification --------------------------------------------------------------------------

Q["p01_origin"] = lambda c: refs.table_names(c.e.columns, c.e.measures, c.e.calc_items).select("table_name", roles.origin(col("table_name")).alias("origin"))
Q["p02_calculated_tables"] = lambda c: c.summary.where("is_calculated").select("table_name")
Q["p03_composite_proxies"] = lambda c: c.summary.where(col("parameter_kind") == "compositeModelProxy").select("table_name", "remote_expression")
Q["p04_parameter_kind"] = lambda c: c.summary.select("table_name", F.coalesce("parameter_kind", F.lit("")).alias("parameter_kind"))
Q["p05_visual_category"] = lambda c: c.e.bindings.select("seq", "visual_type", pages.visual_category(col("visual_type")).alias("category")).where(col("category").isNotNull())
Q["p06_table_groups"] = lambda c: c.summary.select("table_name", roles.table_group().alias("table_group"))
Q["p07_column_keys"] = lambda c: roles.column_keys(c.e.columns, c.e.relationships).select(
    "table_name", "name", "is_key", "is_inferred_pk", "is_fk", "is_hidden", "is_calculated", roles.constraints().alias("constraints")
)
Q["p08_slicer_fields"] = lambda c: usage.with_usage(c.e.columns, c.usage, "column").select("table_name", "name", "is_slicer_field")
Q["p09_search_filter"] = lambda c: lineage.matching(c.e.measures, "ReD", "name", "table_name", "body", "description").select("name", "table_name")
Q["p10_status_filters"] = lambda c: lineage.not_direct(c.mstatus).select("name", F.lit("list").alias("filter")).unionByName(
    lineage.unused_only(c.mstatus).select("name", F.lit("export").alias("filter"))
)
Q["p11_hidden_names"] = lambda c: refs.without_about(c.e.functions).select(F.lit("function").alias("kind"), F.lit("").alias("table_name"), "name").unionByName(
    roles.without_calc_names(c.e.columns, c.e.calc_items).select(F.lit("column").alias("kind"), "table_name", "name")
)
Q["p12_long_enough_bodies"] = lambda c: c.table("documents").select("doc_id", text.normalized_body(col("text")).alias("body")).where(
    F.length("body") >= P.DUPLICATE_MIN_LENGTH
).select("doc_id")

# ---- J: joins ---------------------------------------------------------------------------------------------------


def bound(c: Context, fields: DataFrame, measure: bool) -> DataFrame:
    kind = (col("field_type") == "measure") == F.lit(measure)
    side = fields.select("model_id", "table_name", col("name").alias("field_name"))
    return c.e.bindings.where(kind).join(side, ["model_id", "table_name", "field_name"]).select(
        "seq", "table_name", "field_name", "page_id", "visual_id", "role", "field_type"
    )


Q["j01_measure_bindings"] = lambda c: bound(c, c.e.measures, True)
Q["j02_column_bindings"] = lambda c: bound(c, c.e.columns, False)
Q["j03_dependencies"] = lambda c: refs.dependencies(c.e.measures)
Q["j04_reverse_dependencies"] = lambda c: refs.reverse_dependencies(refs.dependencies(c.e.measures))
Q["j05_columns_in_used_measures"] = lambda c: usage.referenced_columns(c.s, c.mstatus, "compat").withColumn("mode", F.lit("compat")).unionByName(
    usage.referenced_columns(c.s, c.mstatus, "strict").withColumn("mode", F.lit("strict"))
)
Q["j06_relationship_columns"] = lambda c: usage.relationship_columns(c.e.relationships)
Q["j07_key_targets"] = lambda c: roles.column_keys(c.e.columns, c.e.relationships).select("table_name", "name", "fk_table", "fk_column", "incoming_refs", "inactive_refs")
Q["j07_incoming_refs"] = lambda c: roles.incoming_refs(c.e.columns, c.e.relationships)
Q["j08_resolved_partitions"] = lambda c: c.resolved.select("table_name", "part_no", "m_body")
Q["j09_broken_references"] = lambda c: refs.broken_references(c.s.measures, c.s.columns, c.s.calc_items, c.s.functions)
Q["j10_inactive_without_caller"] = lambda c: refs.inactive_without_caller(c.e.relationships, c.e.measures).select("from_table", "from_column", "to_table", "to_column")
Q["j10_inactive_strict"] = lambda c: refs.inactive_without_caller(c.e.relationships, c.e.measures, "strict").select("from_table", "from_column", "to_table", "to_column")
Q["j11_function_uses"] = lambda c: refs.function_uses(c.e.functions, c.e.measures)
Q["j12_column_lineage"] = lambda c: refs.column_mentions(c.e.measures, c.e.columns)
Q["j12_column_lineage_strict"] = lambda c: refs.column_refs(c.e.measures, c.e.columns)
Q["j13_source_map"] = lambda c: impact.source_map(c.s, c.sources, c.summary)
Q["j14_visible_edges"] = lambda c: roles.visible_edges(c.s.relationships, c.summary.where((col("origin") == "user") & (col("role") != "Bridge"))).select(
    "from_table", "from_column", "to_table", "to_column"
)
Q["j15_field_wells"] = lambda c: pages.field_wells(c.e).select("page_id", "visual_id", "category", "role", "table_name", "field_name")

# ---- G: aggregations --------------------------------------------------------------------------------------------

Q["g01_usage_counts"] = lambda c: usage.field_usage(c.e.bindings)
Q["g01_usage_counts_by_page_name"] = lambda c: usage.field_usage(usage.with_page_names(c.e.bindings, c.e.pages), "page_name").select(
    "kind", "table_name", "field_name", "usage_count", "page_count"
)
Q["g02_totals"] = lambda c: usage.totals(c.s, c.mstatus, c.cstatus)
Q["g03_table_counts"] = lambda c: c.summary.select("table_name", "column_count", "measure_count", "key_count", "fk_count", "hidden_count", "partition_count")
Q["g04_page_summary"] = lambda c: c.page_summary.select("page_id", "visual_count", "measure_count", "column_count", "slicer_count", "coverage")
Q["g04_type_counts"] = lambda c: pages.type_counts(c.e)
Q["g04_type_counts_by_title"] = lambda c: pages.type_counts(c.e, "compat")
Q["g05_source_index"] = lambda c: impact.source_index(c.s, c.sources)
Q["g06_status_by_table"] = lambda c: usage.status_by_table(c.mstatus)
Q["g07_role_counts"] = lambda c: roles.role_counts(c.summary)
Q["g07_star_schema"] = lambda c: roles.star_schema(c.summary)
Q["g08_mode_counts"] = lambda c: impact.mode_counts(c.e.partitions, c.summary, True).withColumn("report", F.lit("model")).unionByName(
    impact.mode_counts(c.e.partitions, c.summary, False).withColumn("report", F.lit("sources"))
)
Q["g09_relationship_counts"] = lambda c: roles.relationship_counts(c.e.relationships)
Q["g10_duplicate_bodies"] = lambda c: rules.duplicate_bodies(c.e.measures)
Q["g10_duplicate_documents"] = lambda c: rules.duplicate_bodies(
    c.table("documents").select(F.lit("m0").alias("model_id"), col("source").alias("table_name"), col("doc_id").cast("string").alias("name"), col("text").alias("body"))
).select("name", "body_hash", "copies")
Q["g11_source_buckets"] = lambda c: impact.source_buckets(c.summary, c.sources)
Q["g12_step_cohorts"] = lambda c: impact.step_cohorts(impact.step_signatures(c.resolved))
Q["g13_source_type_counts"] = lambda c: impact.source_map(c.s, c.sources, c.summary).groupBy("source_type").agg(F.count(F.lit(1)).alias("columns"))
Q["g14_glossary_counts"] = lambda c: reports.glossary_counts(reports.glossary(c.s, c.mstatus, c.summary))


def coverage_ratios(c: Context) -> DataFrame:
    def share(df: DataFrame, what: str, hit) -> DataFrame:
        return df.groupBy("model_id").agg(F.round(F.avg(hit.cast("double")), 6).alias("share")).select(F.lit(what).alias("what"), "share")

    bare = ~text.non_empty(col("description"))
    direct = col("status") == "direct"
    parts = [
        share(c.summary.where(col("origin") == "user"), "tables without description", bare), share(c.audit.user(c.s.measures), "measures without description", bare),
        share(c.audit.user(c.e.columns), "columns without description", bare), share(c.audit.user(c.audit.measure_status), "measures direct", direct),
        share(c.audit.user(c.audit.column_status), "columns direct", direct),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


Q["g15_coverage_ratios"] = coverage_ratios
Q["g16_fk_columns_per_dimension"] = lambda c: roles.fk_columns_per_dimension(c.e.relationships)
Q["g17_broken_by_expression"] = lambda c: rules.grouped_broken(refs.broken_references(c.s.measures, c.s.columns, c.s.calc_items, c.s.functions))
Q["g18_proxy_groups"] = lambda c: refs.external_proxies(c.e.measures, c.e.expressions).groupBy("model_id", col("external_model").alias("remote_model")).agg(
    F.count(F.lit(1)).alias("n")
).select("remote_model", "n", F.lit("measures").alias("what")).unionByName(
    impact.proxy_tables(c.summary).groupBy("remote_model").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("tables"))
)
Q["g19_group_rollup"] = lambda c: roles.group_rollup(c.summary)
Q["g20_page_totals"] = lambda c: pages.page_totals(c.page_summary)

# ---- W: first per group, numbering ------------------------------------------------------------------------------

Q["w01_deduped_bindings"] = lambda c: usage.deduped_bindings(c.e.bindings)
Q["w02_first_partition"] = lambda c: first_per_group(c.e.partitions.select("model_id", "table_name", "part_no", "mode", "kind"), ["model_id", "table_name"], [col("part_no")])
Q["w03_column_order"] = lambda c: roles.numbered_columns(c.e.columns, c.e.relationships).select("table_name", "column_no", "name")
Q["w04_numbered_measures"] = lambda c: number_rows(c.e.measures.select("model_id", "name", "table_name"), ["model_id"], [col("name").asc()])
Q["w05_capped_lists"] = lambda c: capped(
    c.e.measures.where(text.is_external(col("body"))).select("model_id", text.external_model(col("body")).alias("remote_model"), "name"),
    ["model_id", "remote_model"], [col("name").asc()], 5,
)
Q["w06_visual_z_order"] = lambda c: pages.z_order(c.e.visuals).select("page_id", "visual_id", "z_no")

# ---- L: sorts and limits ----------------------------------------------------------------------------------------

Q["l01_sorted_measures"] = lambda c: number_rows(
    c.mstatus, ["model_id"], [col("usage_count").desc(), col("name").asc()]
).select("row_no", "name", "usage_count")
Q["l02_source_index_order"] = lambda c: number_rows(impact.source_index(c.s, c.sources), ["model_id"], impact.source_index_order()).select("row_no", "source_key")
Q["l03_biggest_tables"] = lambda c: reports.biggest_tables(c.summary)
Q["l04_search"] = lambda c: lineage.search(c.fields, "m1").select("kind", "table_name", "name", "status", "match")
Q["l04_search_overflow"] = lambda c: lineage.search_hits(c.fields, "m1").agg(
    F.count(F.lit(1)).alias("hits"), F.greatest(F.count(F.lit(1)) - lineage.SEARCH_LIMIT, F.lit(0)).alias("more")
)
Q["l05_page_order"] = lambda c: reports.page_index(c.page_summary).select("row_no", "page_id")
Q["l06_er_columns"] = lambda c: reports.er_columns(c.s, c.summary)
Q["l07_role_order"] = lambda c: c.summary.where(col("origin") == "user").select("table_name", "role", roles.role_rank().alias("role_order"))

# ---- U: set operations ------------------------------------------------------------------------------------------

Q["u01_glossary"] = lambda c: reports.glossary(c.s, c.mstatus, c.summary)
Q["u02_table_names"] = lambda c: refs.table_names(c.e.columns, c.e.measures, c.e.calc_items)
Q["u03_all_pages"] = lambda c: c.page_summary.select("page_id", "name", "hidden", "width", "height", "measure_count", "column_count")
Q["u04_user_tables"] = lambda c: c.summary.where(col("origin") == "user").select("table_name")
Q["u05_table_usage"] = lambda c: impact.table_bindings(c.e).groupBy("model_id", "table_name").agg(
    F.count(F.lit(1)).alias("visuals"), F.countDistinct("page_id").alias("pages")
)
Q["u06_table_relationships"] = lambda c: roles.table_relationships(c.e.relationships)

# ---- R: graph ---------------------------------------------------------------------------------------------------

Q["r01_measure_status"] = lambda c: c.mstatus
Q["r01_measure_status_compat"] = lambda c: usage.measure_status(c.s, "compat")
Q["r02_column_status"] = lambda c: c.cstatus
Q["r02_column_status_strict"] = lambda c: usage.column_status(c.s, checkpoint(c.mstatus), "strict", c.column_usage).select("table_name", "name", "status")
Q["r03_dead_chains"] = lambda c: graph.dead_chains(c.edges, c.mstatus).select("name")
Q["r03_dead_chains_given_status"] = lambda c: graph.dead_chains(
    c.edges, c.mstatus.withColumn("status", F.when(col("status") == "direct", "direct").otherwise("indirect"))
).select("name")
Q["r04_orphans"] = lambda c: usage.orphans(c.mstatus, c.edges)
Q["r05_cycle_members"] = lambda c: graph.cycles(c.edges).select("component", "node")
Q["r05_cycle_paths"] = lambda c: graph.rings(c.edges)
Q["r06_lineage"] = lambda c: lineage.lineage_edges(c.s, edges=c.edges)
Q["r07_table_roles"] = lambda c: c.summary.select("table_name", "role", "outgoing", "incoming")
Q["r08_source_impact"] = lambda c: impact.source_impact(c.s, c.sources)
Q["r08_transitive_impact"] = lambda c: impact.transitive_impact(c.s, c.sources, c.edges)

# ---- A: audit ---------------------------------------------------------------------------------------------------

AUDIT_NAMES = {
    "A1": "auto_date", "A2": "cycles", "A3": "broken", "A4": "calculated_direct_query", "A5": "unused_measures", "A6": "dead_chain",
    "A7": "unused_columns", "A8": "dead_relationships", "A9": "tables_undescribed", "A10": "measures_undescribed", "A11": "long_bodies",
    "A12": "duplicates", "A13": "empty_pages", "A14": "url_categories", "A15": "columns_undescribed", "A16": "model_undescribed",
    "A17": "numeric_unformatted", "A18": "external_proxies", "A19": "field_parameters", "A20": "composite_proxies",
    "A21": "measure_utilisation", "A22": "column_utilisation", "A23": "no_cycles", "A24": "calc_groups",
}
for _check, _name in AUDIT_NAMES.items():
    Q[f"a{int(_check[1:]):02d}_{_name}"] = lambda c, check=_check: c.audit.findings(check).select("severity", "check_id", "entity", "detail")
Q["a25_severity_summary"] = lambda c: rules.severity_summary(c.findings)
Q["a25_finding_texts"] = lambda c: messages.described(c.findings)

# ---- D: report tables -------------------------------------------------------------------------------------------

Q["d01_model_properties"] = lambda c: reports.model_properties(c.s, usage.totals(c.s, c.mstatus, c.cstatus))
Q["d01_relationship_inventory"] = lambda c: reports.relationship_inventory(c.e.relationships)
Q["d01_expression_inventory"] = lambda c: reports.expression_inventory(c.e.expressions)
Q["d01_function_summary"] = lambda c: reports.function_summary(c.e.functions)
Q["d01_calc_group_summary"] = lambda c: reports.calc_group_summary(c.e.calc_items)
Q["d01_page_table"] = lambda c: reports.page_table(c.page_summary)
Q["d02_measures_lite"] = lambda c: reports.measures_lite(c.s, c.mstatus)
Q["d02_measures_detailed"] = lambda c: reports.measures_detailed(c.s, c.mstatus, c.edges)
Q["d03_functions"] = lambda c: reports.functions_reference(c.e)
Q["d04_calc_groups"] = lambda c: reports.calc_groups_reference(c.e)
Q["d05_data_dictionary"] = lambda c: reports.data_dictionary(c.s, c.summary)
Q["d05_hierarchies"] = lambda c: reports.hierarchy_levels(c.e.hierarchies)
Q["d06_source_report"] = lambda c: reports.source_report(c.summary, c.sources)
Q["d06_raw_bodies"] = lambda c: impact.raw_bodies(c.resolved)
Q["d07_visual_bindings"] = lambda c: reports.visual_bindings(c.e)
Q["d09_shown_findings"] = lambda c: rules.shown_findings(c.findings)
Q["d10_documents_per_mode"] = lambda c: reports.emitted_documents(c.e)
Q["d11_usage_tiles"] = lambda c: reports.usage_tiles(usage.totals(c.s, c.mstatus, c.cstatus), pages.page_totals(c.page_summary))
Q["d13_er_edges"] = lambda c: roles.er_edges(c.s.relationships, reports.er_tables(c.summary))
Q["d14_broken_links"] = lambda c: links.broken(c.linked)
Q["d14_link_targets"] = lambda c: links.targets(links.unfenced(c.linked))
Q["d14_links"] = lambda c: links.references(links.unfenced(c.linked)).groupBy("model_id", "doc", "target", "fragment").agg(F.count(F.lit(1)).alias("links"))

# ---- K: sinks (the rows they write) -----------------------------------------------------------------------------

Q["k01_csv_measures"] = lambda c: csv.measure_rows(c.s, c.mstatus, "re", unused=True)
Q["k01_csv_columns"] = lambda c: csv.column_rows(c.e, c.cstatus)
Q["k01_csv_relationships"] = lambda c: csv.relationship_rows(c.e.relationships)
Q["k01_csv_source_map"] = lambda c: csv.source_map_rows(impact.source_map(c.s, c.sources, c.summary))
Q["k02_read_back"] = lambda c: saved(c, "measures", c.e.measures).select("table_name", "name", "body", "description")
Q["k03_markdown_measures"] = lambda c: reports.measures_lite(c.s, c.mstatus).select(
    "name", md.table_row(col("name"), col("table_name"), col("status"), col("format"), col("description")).alias("line")
)
Q["k03_document_files"] = lambda c: written_documents(c, documents.measures_doc(c.s, c.mstatus, linked=True).unionByName(documents.functions_doc(c.e)))


def saved(c: Context, name: str, df: DataFrame) -> DataFrame:
    """A table of the estate written to the shared folder and read back through its manifest."""
    folder = f"{checkpoint_folder(c.spark)}/tables-{uuid.uuid4().hex}"
    tables.write_table(df, f"{folder}/{name}")
    return getattr(Estate.read(c.spark, folder, ["m0"]), name)


def written_documents(c: Context, lines: DataFrame) -> DataFrame:
    """The documents written to the shared folder and read back, line by line, with the number of files each takes."""
    folder = f"{checkpoint_folder(c.spark)}/markdown-{uuid.uuid4().hex}"
    md.write_markdown(lines, folder)
    back = c.spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.input_file_name().alias("_file"))
    doc = F.regexp_extract("_file", r"([^/]+)\.md$", 1)
    files = back.select(doc.alias("doc"), "_file").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("files"))
    return back.select(doc.alias("doc"), F.col("value").alias("line")).groupBy("doc", "line").agg(F.count(F.lit(1)).alias("times")).join(files, "doc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Context(spark, sf_dir)).drop("model_id")

    return {name: bind(build) for name, build in QUERIES.items()}
