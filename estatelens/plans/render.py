"""The derived estate written as project files: rows ``(workspace, path, content)`` the readers in ``sources`` parse.

Parsing what was rendered must give the derived rows back, which is how the readers are checked at any scale.  A file
holds one table, visual or relationship end, so no file grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.plans.derived import spark_view

col, lit = F.col, F.lit


def _files(df: DataFrame, path: Column, content: Column) -> DataFrame:
    return df.select(lit("ws").alias("workspace"), path.alias("path"), content.alias("content"))


def model_path(owner: Column, place: str) -> Column:
    return F.concat(lit("/ws/"), owner, lit(f".SemanticModel/definition/{place}"))


def quoted(name: Column) -> Column:
    return F.concat(lit("'"), name, lit("'"))


def _prop(tabs: int, name: str, value: Column) -> Column:
    return F.when(value != "", F.concat(lit("\n" + "\t" * tabs + name + ": "), value)).otherwise("")


def _deeper(text: Column, tabs: int) -> Column:
    return F.replace(text, lit("\n"), lit("\n" + "\t" * tabs))


def _gathered() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "name", "block"))), lambda b: b["block"]), "\n\n")


def table_files(e: Estate) -> DataFrame:
    """A text file per table with its columns and measures (a handful each)."""
    c = e.columns
    flags = F.concat(*[F.when(col(f), f"\n\t\t{word}: true").otherwise("") for f, word in (("is_key", "isKey"), ("is_hidden", "isHidden"))])
    extra = F.when(col("has_param_metadata"), '\n\t\textendedProperty ParameterMetadata =\n\t\t\t\t{ "version": 3 }').otherwise("")
    doc = F.when(col("description") != "", F.concat(lit("\t/// "), col("description"), lit("\n"))).otherwise("")
    column_block = F.concat(
        doc, lit("\tcolumn "), quoted(col("name")), F.when(col("is_calculated"), " = 1").otherwise(""), _prop(2, "dataType", col("data_type")), flags,
        _prop(2, "formatString", col("format_string")), _prop(2, "summarizeBy", col("summarize_by")), _prop(2, "sortByColumn", col("sort_by_column")),
        _prop(2, "dataCategory", col("data_category")), _prop(2, "displayFolder", col("display_folder")), extra,
    )
    measure_block = F.concat(
        lit("\tmeasure "), quoted(col("name")), lit(" = "), _deeper(col("body"), 3), _prop(2, "formatString", col("format_string")),
        _prop(2, "displayFolder", col("display_folder")), _prop(2, "description", col("description")), lit("\n\t\tlineageTag: 1"),
    )
    blocks = c.select("table_name", lit("c").alias("kind"), "name", column_block.alias("block")).unionByName(
        e.measures.select("table_name", lit("m").alias("kind"), "name", measure_block.alias("block"))
    ).groupBy("table_name").agg(_gathered().alias("_text"))
    described = e.tables.select("table_name", F.when(col("description") != "", F.concat(lit("/// "), col("description"), lit("\n"))).otherwise("").alias("_doc"))
    both = blocks.join(described, "table_name")
    return _files(both, model_path(col("table_name"), "tables/t.tmdl"), F.concat("_doc", lit("table "), quoted(col("table_name")), lit("\n\n"), "_text", lit("\n")))


def partition_files(e: Estate) -> DataFrame:
    head = F.concat(lit("table "), quoted(col("table_name")), lit("\n\tpartition "), quoted(col("name")), lit(" = "), col("kind"), lit("\n\t\tmode: "), col("mode"))
    entity = F.concat(lit("\n\t\tsource\n\t\t\t"), _deeper(col("m_body"), 3), lit("\n\t\t\texpressionSource: "), quoted(col("expression_source")))
    inline = F.concat(lit("\n\t\tsource =\n\t\t\t"), _deeper(col("m_body"), 3))
    text = F.concat(head, F.when(col("expression_source") != "", entity).otherwise(inline), lit("\n\n\tannotation Done = 1\n"))
    return _files(e.partitions, model_path(F.concat_ws("_", "table_name", "part_no"), "tables/t.tmdl"), text)


def calc_item_files(e: Estate) -> DataFrame:
    body = F.when(col("body").contains("\n"), F.concat(lit("\n\t\t\t\t"), _deeper(col("body"), 4))).otherwise(F.concat(lit(" "), col("body")))
    doc = F.when(col("description") != "", F.concat(lit("\n\n\t\t/// "), col("description"))).otherwise("")
    text = F.concat(
        lit("table "), col("group_name"), lit("\n\tcalculationGroup\n\t\tprecedence: "), col("precedence"), doc, lit("\n\t\tcalculationItem "), quoted(col("name")), lit(" ="),
        body, _prop(2, "formatStringExpression", col("format_expr")), lit("\n\n\tcolumn Name\n"),
    )
    return _files(e.calc_items, model_path(F.concat_ws("_", "group_name", "ordinal"), "tables/t.tmdl"), text)


def hierarchy_files(e: Estate) -> DataFrame:
    doc = F.when(col("description") != "", F.concat(lit("\t\t/// "), col("description"), lit("\n"))).otherwise("")
    level = F.concat(doc, lit("\t\tlevel "), quoted(col("level")), lit("\n\t\t\tlineageTag: 2\n\t\t\tcolumn: "), quoted(col("column_name")))
    per = e.hierarchies.select("table_name", "hierarchy", F.lpad(col("level_no").cast("string"), 9, "0").alias("name"), lit("").alias("kind"), level.alias("block"))
    text = per.groupBy("table_name", "hierarchy").agg(_gathered().alias("_text"))
    return _files(text, model_path(col("table_name"), "tables/t.tmdl"), F.concat(lit("table "), col("table_name"), lit("\n\thierarchy "), quoted(col("hierarchy")), lit("\n"), "_text", lit("\n")))


def relationship_files(e: Estate) -> DataFrame:
    block = F.concat(
        lit("relationship "), F.col("rel_no"), F.when(~col("is_active"), "\n\tisActive: false").otherwise(""), F.when(col("from_card") != "many", F.concat(lit("\n\tfromCardinality: "), "from_card")).otherwise(""),
        F.when(col("to_card") != "one", F.concat(lit("\n\ttoCardinality: "), "to_card")).otherwise(""), F.when(col("cross_filter") != "oneDirection", F.concat(lit("\n\tcrossFilteringBehavior: "), "cross_filter")).otherwise(""),
        lit("\n\tfromColumn: "), quoted(col("from_table")), lit("."), quoted(col("from_column")), lit("\n\ttoColumn: "), col("to_table"), lit("."), col("to_column"),
    )
    per = e.relationships.select("from_table", "to_table", lit("").alias("kind"), F.lpad(col("rel_no").cast("string"), 20, "0").alias("name"), block.alias("block"))
    text = per.groupBy("from_table", "to_table").agg(_gathered().alias("_text"))
    return _files(text, model_path(F.concat_ws("_", "from_table", "to_table"), "relationships.tmdl"), F.concat("_text", lit("\n")))


def expression_files(e: Estate) -> DataFrame:
    doc = F.when(col("description") != "", F.concat(lit("/// "), col("description"), lit("\n"))).otherwise("")
    inline = F.concat(lit(" "), col("value"), F.when(col("metadata") != "", F.concat(lit(" meta ["), "metadata", lit("]"))).otherwise(""))
    body = F.when(col("value").contains("\n"), F.concat(lit("\n\t\t"), _deeper(col("value"), 2))).otherwise(inline)
    text = F.concat(doc, lit("expression "), quoted(col("name")), lit(" ="), body, lit("\n\tlineageTag: 7\n"))
    return _files(e.expressions, model_path(F.replace("name", lit(" "), lit("_")), "expressions.tmdl"), text)


def function_files(e: Estate) -> DataFrame:
    doc = F.when(col("description") != "", F.concat(lit("/// "), col("description"), lit("\n"))).otherwise("")
    head = F.when(col("parameters") != "", F.concat(lit("("), "parameters", lit(") =>\n\t\t"))).otherwise("")
    text = F.concat(doc, lit("function "), quoted(col("name")), lit(" = ```\n\t\t"), head, col("body"), lit("\n\t\t```\n\tlineageTag: 8\n"))
    return _files(e.functions, model_path(col("name"), "functions.tmdl"), text)


def model_files(e: Estate) -> DataFrame:
    text = F.concat(lit("model "), col("name"), lit("\n\tculture: "), col("culture"), F.when(col("discourage_implicit"), "\n\tdiscourageImplicitMeasures").otherwise(""), lit("\n\nref table X\n"))
    level = F.concat(lit("database\n\tcompatibilityLevel: "), col("compatibility_level").cast("string"), lit("\n"))
    parts = [(lit("model.tmdl"), text), (lit("database.tmdl"), level), (F.concat(lit("cultures/"), col("culture"), lit(".tmdl")), lit("cultureInfo"))]
    each = e.models.select("name", F.explode(F.array(*[F.struct(p.alias("place"), t.alias("content")) for p, t in parts])).alias("_f"))
    return _files(each, F.concat(lit("/ws/"), "name", lit(".SemanticModel/definition/"), "_f.place"), col("_f.content"))


def bim_files(e: Estate) -> DataFrame:
    """A JSON model per table: columns, measures, partitions and outgoing relationships of one table each."""
    flag = {n: F.when(col(n), True) for n in ("is_key", "is_hidden", "is_calculated")}
    column = F.struct(
        "name", F.when(col("is_calculated"), "calculated").alias("type"), col("data_type").alias("dataType"), flag["is_key"].alias("isKey"), flag["is_hidden"].alias("isHidden"),
        "description", col("display_folder").alias("displayFolder"), col("summarize_by").alias("summarizeBy"), col("sort_by_column").alias("sortByColumn"),
        col("data_category").alias("dataCategory"), col("format_string").alias("formatString"),
        F.when(col("has_param_metadata"), F.array(F.struct(lit("ParameterMetadata").alias("name")))).alias("extendedProperties"),
    )
    measure = F.struct("name", F.split("body", "\n").alias("expression"), col("format_string").alias("formatString"), "description", col("display_folder").alias("displayFolder"))
    partition = F.struct("name", "mode", F.struct(col("kind").alias("type"), col("m_body").alias("expression"), F.nullif("expression_source", lit("")).alias("expressionSource")).alias("source"))
    relation = F.struct(
        col("from_table").alias("fromTable"), col("from_column").alias("fromColumn"), col("to_table").alias("toTable"), col("to_column").alias("toColumn"),
        F.when(~col("is_active"), False).alias("isActive"), col("from_card").alias("fromCardinality"), col("to_card").alias("toCardinality"), col("cross_filter").alias("crossFilteringBehavior"),
    )
    sides = [
        e.columns.groupBy("table_name").agg(F.collect_list(column).alias("columns")), e.measures.groupBy("table_name").agg(F.collect_list(measure).alias("measures")),
        e.partitions.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_no", partition.alias("p")))), lambda x: x["p"]).alias("partitions")),
        e.relationships.groupBy(col("from_table").alias("table_name")).agg(F.collect_list(relation).alias("_relations")),
    ]
    joined = sides[0].select("table_name")
    for side in sides[1:]:
        joined = joined.union(side.select("table_name"))
    joined = joined.distinct()
    for side in sides:
        joined = joined.join(side, "table_name", "left")
    table = F.struct(col("table_name").alias("name"), "columns", "measures", "partitions")
    model = F.struct(F.struct(col("table_name").alias("name"), F.array(table).alias("tables"), col("_relations").alias("relationships")).alias("model"))
    return _files(joined, F.concat(lit("/ws/"), "table_name", lit(".SemanticModel/model.bim")), F.to_json(model))


def page_path(*rest: Column) -> Column:
    return F.concat(lit("/ws/P"), col("page_id"), lit(".Report/definition/pages/"), *rest)


def page_files(e: Estate) -> DataFrame:
    order = F.to_json(F.struct(F.array("page_id").alias("pageOrder")))
    page = F.to_json(F.struct(col("name").alias("displayName"), F.when(col("hidden"), "HiddenInViewMode").alias("visibility"), "width", F.when(col("height") != 720, col("height")).alias("height")))
    return _files(e.pages, page_path(lit("pages.json")), order).unionByName(_files(e.pages, page_path(col("page_id"), lit("/page.json")), page))


def _visual_path(name: str) -> Column:
    return page_path(col("page_id"), lit("/visuals/"), col(name).cast("string"), lit("/visual.json"))


def visual_files(e: Estate) -> DataFrame:
    literal = F.struct(F.struct(F.struct(quoted(col("title")).alias("Value")).alias("Literal")).alias("expr")).alias("text")
    title = F.struct(F.array(F.struct(F.struct(literal).alias("properties"))).alias("title")).alias("visualContainerObjects")
    body = F.struct(col("visual_id").alias("name"), F.struct("x", "y", "z", "width", "height").alias("position"), F.struct(col("visual_type").alias("visualType"), title).alias("visual"))
    return _files(e.visuals, _visual_path("visual_id"), F.to_json(body))


def _field() -> Column:
    owner = F.struct(col("field_name").alias("Property"), F.struct(F.struct(col("table_name").alias("Entity")).alias("SourceRef")).alias("Expression"))
    as_level = (col("field_type") == "column") & (col("seq") % 7 == 0)
    level = F.struct(col("field_name").alias("Level"), F.struct(F.struct(F.struct(F.struct(col("table_name").alias("Entity")).alias("SourceRef")).alias("Expression")).alias("Hierarchy")).alias("Expression"))
    return F.struct(
        F.when(col("field_type") == "measure", owner).alias("Measure"), F.when((col("field_type") == "column") & ~as_level, owner).alias("Column"),
        F.when(col("field_type") == "aggregation", F.struct(F.struct(owner.alias("Column")).alias("Expression"))).alias("Aggregation"), F.when(as_level, level).alias("HierarchyLevel"),
    )


def binding_files(e: Estate, formatting: bool = False) -> DataFrame:
    """A visual file per binding: in a well, in the visual's filters or, with ``formatting``, somewhere below ``objects``."""
    filters = F.when(col("role") == "Filter", F.struct(F.array(F.struct(_field().alias("field"))).alias("filters")))
    wells = F.when(col("role") != "Filter", F.create_map(col("role"), F.struct(F.array(F.struct(_field().alias("field"))).alias("projections"))))
    reference = F.struct(_field().alias("expr"))
    shallow = F.when(col("seq") % 2 == 0, reference).alias("value")
    deep = F.when(col("seq") % 2 == 1, F.array(F.struct(F.struct(reference.alias("color")).alias("solid")))).alias("fill")
    objects = F.create_map(col("role"), F.array(F.struct(F.struct(shallow, deep).alias("properties"))))
    inside = F.struct(col("visual_type").alias("visualType"), objects.alias("objects")) if formatting else F.struct(
        col("visual_type").alias("visualType"), F.struct(wells.alias("queryState")).alias("query")
    )
    parts = [inside.alias("visual")] if formatting else [inside.alias("visual"), filters.alias("filterConfig")]
    return _files(e.bindings, _visual_path("seq"), F.to_json(F.struct(*parts)))


def corpus_files(spark, sf_dir: str) -> DataFrame:
    """Folders of reports and models as a user would keep them, one workspace per nation."""
    reports = spark_view(spark, sf_dir, "y_reports")
    root = F.concat("folder", lit("/"), "stem", lit(".Report/"))
    pointer = F.when(col("pointer") != "", F.to_json(F.struct(F.struct(F.struct(col("pointer").alias("path")).alias("byPath")).alias("datasetReference")))).otherwise("{}")
    pbir = reports.where(col("k") % 6 != 1).select("workspace", F.concat(root, lit("definition.pbir")).alias("path"), pointer.alias("content"))
    other = reports.where(col("k") % 6 == 1).select("workspace", F.concat(root, lit("report.json")).alias("path"), lit("{}").alias("content"))
    place = F.when(col("format") == "tmdl", "/definition/tables/t.tmdl").when(col("format") == "bim", "/model.bim").otherwise("/item.json")
    models = spark_view(spark, sf_dir, "y_models").select("workspace", F.concat("model", place).alias("path"), lit("{}").alias("content"))
    return pbir.unionByName(other).unionByName(models)
