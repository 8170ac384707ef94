"""The documents of every model as Markdown lines, built from the report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.operators import audit as rules
from estatelens.operators import impact, messages, pages, roles, usage
from estatelens.plans import reports
from estatelens.session import checkpoint
from estatelens.sinks import markdown as md

c = F.col


def measures_doc(estate: Estate, statuses: DataFrame, linked: bool = False) -> DataFrame:
    """Every measure with an anchor of its own; ``linked`` where the dictionary, with a heading for each table, is written too."""
    lite = reports.measures_lite(estate, statuses)
    table = md.link(c("table_name"), "DataDictionary", c("table_name")) if linked else c("table_name")
    return md.table(
        estate.models, lite, "Measures", 10, "Measures", ["Name", "Table", "Status", "Format", "Description"],
        [F.concat(md.anchor(c("name")), c("name")), table, c("status"), c("format"), c("description")], c("name"), c("table_name"),
    )


def dictionary_doc(estate: Estate, summary: DataFrame) -> DataFrame:
    """A heading and a table of columns for each user table, by role."""
    rows = reports.data_dictionary(estate, summary)
    heads = ["#", "Name", "Type", "Constraints", "Summarize by", "Sort by", "Category", "Format", "Description"]
    cells = [c("column_no"), c("name"), c("data_type"), c("constraints"), c("summarize_by"), c("sort_by"), c("category"), c("format"), c("description")]
    place = F.concat(md.padded(roles.role_rank()), c("table_name"))
    user = summary.where(c("origin") == "user")
    top = md.fixed(estate.models, "DataDictionary", 10, "## Columns", "")
    each = F.array(F.concat(F.lit("### "), c("table_name")), F.concat(F.lit("Role: "), c("role")), F.lit(""), F.lit("| " + " | ".join(heads) + " |"), F.lit("|" + "---|" * len(heads)))
    titles = user.select("model_id", "table_name", "role", F.posexplode(each).alias("_n", "_line"))
    begun = md.rows(titles, "DataDictionary", 11, c("_line"), place, F.concat(F.lit("0"), c("_n").cast("string")))
    return top.unionByName(begun).unionByName(md.rows(rows, "DataDictionary", 11, md.table_row(*cells), place, F.concat(F.lit("1"), md.padded(c("column_no")))))


def sources_doc(estate: Estate, summary: DataFrame, sources: DataFrame) -> DataFrame:
    tables = md.table(
        estate.models, reports.source_report(summary, sources), "Sources", 10, "Data Sources",
        ["Source", "Table", "Mode", "Kind", "Columns", "Measures", "File / detail"],
        [c("bucket"), c("table_name"), c("mode"), c("kind"), c("column_count"), c("measure_count"), c("detail")],
        c("bucket"), c("table_name"),
    )
    index = md.table(
        estate.models, impact.source_index(estate, sources), "Sources", 20, "Physical-source index",
        ["Kind", "Server / Host", "Database", "Schema / Folder", "Table / File", "Model tables", "Visuals", "Pages"],
        [*[reports.dash(c(x)) for x in ("kind", "server", "database", "schema", "name")], c("table_list"), c("visual_count"), c("page_count")],
        md.padded(F.lit(999_999_999) - c("visual_count")), F.concat(md.padded(F.lit(999_999_999) - c("table_count")), c("source_key")),
    )
    native = md.table(
        estate.models, sources.where(c("native_query") != ""), "Sources", 30, "Native queries", ["Table", "Partition", "SQL"],
        [c("table_name"), c("name"), c("native_query")], c("table_name"), md.padded(c("part_no")),
    )
    return tables.unionByName(index).unionByName(native)


def pages_doc(estate: Estate, summary: DataFrame, linked: bool = False) -> DataFrame:
    """The list of pages, then each page's bindings below a heading of its own; fields link to their measure or their table."""
    index = reports.page_index(summary)
    listed = md.table(
        estate.models, index, "Pages", 10, "Pages", ["#", "Page", "Visibility", "Visuals", "Measures", "Columns", "Slicers"],
        [c("row_no"), c("name"), F.when(c("hidden"), "Hidden").otherwise("Visible"), c("visual_count"), c("measure_count"),
         c("column_count"), c("slicer_count")],
        md.padded(c("row_no")),
    )
    place = index.select("model_id", "page_id", "name", "row_no")
    each = F.array(F.concat(F.lit("### "), c("name")), F.lit(""), F.lit("| Visual | Type | Title | Field |"), F.lit("|---|---|---|---|"))
    titles = md.rows(place.select("*", F.posexplode(each).alias("_n", "_line")), "Pages", 20, c("_line"), md.padded(c("row_no")), F.concat(F.lit("0"), c("_n").cast("string")))
    bound = usage.deduped_bindings(estate.bindings).join(place.select("model_id", "page_id", "row_no"), ["model_id", "page_id"])
    field = F.concat(c("table_name"), F.lit("["), c("field_name"), F.lit("]"))
    label = F.concat_ws(".", "table_name", "field_name")  # brackets end a link's text
    to = F.when(c("kind") == "measure", md.link(label, "Measures", c("field_name"))).when(roles.is_auto_date(c("table_name")), field).otherwise(
        md.link(label, "DataDictionary", c("table_name"))
    )
    cells = md.table_row(c("visual_id"), c("visual_type"), c("title"), to if linked else field)
    return listed.unionByName(titles).unionByName(md.rows(bound, "Pages", 20, cells, md.padded(c("row_no")), F.concat_ws("|", F.lit("1"), "visual_id", "kind", "table_name", "field_name")))


def functions_doc(estate: Estate) -> DataFrame:
    rows = reports.functions_reference(estate)
    with_any = estate.models.join(rows.select("model_id").distinct(), "model_id", "left_semi")
    return md.table(
        with_any, rows, "Functions", 10, "Functions", ["Function", "Signature", "Parameters", "Used by"],
        [c("name"), c("signature"), c("parameters"), c("used_by")], c("name"),
    )


def calc_groups_doc(estate: Estate) -> DataFrame:
    rows = reports.calc_groups_reference(estate)
    with_any = estate.models.join(estate.calc_items.select("model_id").distinct(), "model_id", "left_semi")
    return md.table(
        with_any, rows, "CalcGroups", 10, "Calculation groups", ["Group", "Precedence", "Ordinal", "Item", "Body", "Format", "Description"],
        [c("group_name"), c("precedence"), c("ordinal"), c("name"), c("body"), c("format_expr"), c("description")],
        c("group_name"), md.padded(c("item_no")),
    )


def index_doc(estate: Estate, statuses: DataFrame, summary: DataFrame) -> DataFrame:
    entries = reports.glossary(estate, statuses, summary)
    rank = F.coalesce(*[F.when(c("kind") == k, n) for n, k in enumerate(reports.KIND_ORDER)], F.lit(9))
    name = (
        F.when(c("kind").isin("Table", "Calc group"), md.link(c("name"), "DataDictionary", c("name"))).when(c("kind") == "Measure", md.link(c("name"), "Measures", c("name")))
        .when(c("kind") == "Column", md.link(c("name"), "DataDictionary", c("parent"))).otherwise(c("name"))
    )
    return md.table(
        estate.models, entries, "Index", 10, "Glossary", ["Letter", "Kind", "Name", "Parent", "Note", "Description"],
        [c("letter"), c("kind"), name, c("parent"), c("note"), c("description")],
        F.concat(F.when(c("letter") == "#", "~").otherwise(c("letter")), rank.cast("string")), F.concat_ws("|", "name", "parent"),
    )


def improvements_doc(estate: Estate, findings: DataFrame) -> DataFrame:
    findings = checkpoint(findings)
    shown = rules.shown_findings(findings)
    rank = F.coalesce(*[F.when(c("severity") == s, n) for n, s in enumerate(rules.SEVERITIES)])
    listed = md.table(
        estate.models, shown, "Improvements", 20, "Findings", ["Severity", "Check", "Entity", "Detail"],
        [c("severity"), c("check_id"), c("entity"), c("detail")], F.concat(rank.cast("string"), c("check_id")), md.padded(c("item_no")),
    )
    rest = shown.where((c("more") > 0) & (c("item_no") == 1))
    more = md.rows(rest, "Improvements", 30, md.table_row(c("severity"), c("check_id"), F.concat(F.lit("…and "), c("more").cast("string"), F.lit(" more"))), c("check_id"))
    counts = md.table(
        estate.models, rules.severity_summary(findings), "Improvements", 10, "Summary", ["Severity", "Checks", "Rows"],
        [c("severity"), c("checks"), c("rows")], c("severity_order"),
    )
    texts = messages.described(findings).withColumn("_rank", F.coalesce(*[F.when(c("severity") == s, n) for n, s in enumerate(rules.SEVERITIES)]))
    said = F.array(
        F.concat(F.lit("### "), c("title")), c("summary"), F.when(c("rationale") != "", F.concat(F.lit("_"), c("rationale"), F.lit("_"))),
        F.when(c("see") != "", F.concat(F.lit("See [" ), c("see"), F.lit("]("), c("see"), F.lit(".md)"))), F.lit(""),
    )
    each = texts.select("model_id", "check_id", "_rank", F.posexplode(F.filter(said, lambda x: x.isNotNull())).alias("_n", "_line"))
    rule = F.concat(c("_rank").cast("string"), F.lpad(F.substring("check_id", 2, 2), 2, "0"))
    return counts.unionByName(md.rows(each, "Improvements", 15, c("_line"), rule, c("_n").cast("string"))).unionByName(listed).unionByName(more)


def model_doc(estate: Estate, summary: DataFrame) -> DataFrame:
    tables = md.table(
        estate.models, summary.where(c("origin") == "user"), "Model", 10, "Tables by role",
        ["Table", "Role", "Columns", "Measures", "Keys", "FKs", "Hidden cols"],
        [c("table_name"), c("role"), c("column_count"), c("measure_count"), c("key_count"), c("fk_count"), c("hidden_count")], c("table_name"),
    )
    relations = md.table(
        estate.models, reports.relationship_inventory(estate.relationships), "Model", 20, "Relationship inventory",
        ["#", "From", "To", "Cardinality", "Filter", "Active"],
        [c("row_no"), c("from_end"), c("to_end"), c("cardinality"), c("filter"), c("active")], md.padded(c("row_no")),
    )
    return tables.unionByName(relations)


def linked_documents(estate: Estate, statuses: DataFrame, summary: DataFrame) -> DataFrame:
    """The lines of the documents that link to each other."""
    parts = [
        measures_doc(estate, statuses, True), dictionary_doc(estate, summary), pages_doc(estate, pages.page_summary(estate), True),
        index_doc(estate, statuses, summary),
    ]
    return reduce(DataFrame.unionByName, parts)


def documents(estate: Estate, mode: str = "detailed") -> DataFrame:
    """All lines of all documents; ``lite`` leaves the reference documents out."""
    audit = rules.Audit(estate)
    statuses, summary = audit.measure_status, audit.summary
    sources = impact.inferred_sources(impact.resolve_partitions(estate.partitions, estate.expressions))
    parts = [
        model_doc(estate, summary), sources_doc(estate, summary, sources), measures_doc(estate, statuses, mode == "detailed"), functions_doc(estate),
        calc_groups_doc(estate), pages_doc(estate, pages.page_summary(estate), mode == "detailed"), improvements_doc(estate, audit.findings()),
    ]
    if mode == "detailed":
        parts += [dictionary_doc(estate, summary), index_doc(estate, statuses, summary)]
    return reduce(DataFrame.unionByName, parts)



