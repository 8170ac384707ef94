"""Report definitions: pages, visuals and field bindings out of the JSON files of a report folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from estatelens.functions import patterns as P
from estatelens.session import checkpoint
from estatelens.sources.files import at, path_part

# The fields read from page and visual files
_SOURCE = "Expression struct<SourceRef: struct<Entity: string>>"
_PROPERTY = f"struct<Property: string, {_SOURCE.replace(' ', ': ', 1)}>"
FIELD = (
    f"struct<Measure: {_PROPERTY}, Column: {_PROPERTY}, Aggregation: struct<Expression: struct<Column: {_PROPERTY}>>,"
    " HierarchyLevel: struct<Level: string, Expression: struct<Hierarchy: struct<Expression: struct<SourceRef: struct<Entity: string>>>>>>"
)
PAGE = "displayName string, visibility string, width double, height double"
VISUAL = (
    "name string, position struct<x: double, y: double, z: double, width: double, height: double>,"
    " visual struct<visualType: string,"
    " visualContainerObjects: struct<title: array<struct<properties: struct<text: struct<expr: struct<Literal: struct<Value: string>>>>>>>,"
    f" query: struct<queryState: map<string, struct<projections: array<struct<field: {FIELD}>>>>>>,"
    f" filterConfig struct<filters: array<struct<field: {FIELD}>>>"
)
FORMATTING = 1 << 40  # formatting follows wells and filters in a visual's binding numbers, which are positions in arrays, so below 2**31
LEVELS = 3


def page_rows(files: DataFrame) -> DataFrame:
    """Pages in the report's order: name (else id), hidden flag, canvas size with defaults, number of visual files."""
    order = F.from_json("content", "pageOrder array<string>")["pageOrder"]
    listed = at(files, "pages").select(
        path_part("pages").alias("report"), F.posexplode(order).alias("page_no", "page_id")
    )
    page = F.from_json("content", PAGE).alias("_p")
    bodies = at(files, "page").select(path_part("page").alias("report"), path_part("page", 2).alias("page_id"), page)
    counts = at(files, "visual").groupBy(path_part("visual").alias("report"), path_part("visual", 2).alias("page_id")).agg(F.count(F.lit(1)).alias("visual_count"))
    keys = ["report", "page_id"]
    width, height = P.DEFAULT_PAGE_SIZE
    return listed.join(bodies, keys, "left").join(counts, keys, "left").select(
        *keys, F.col("page_no").cast("long").alias("page_no"), F.coalesce(F.nullif("_p.displayName", F.lit("")), "page_id").alias("name"),
        F.coalesce(F.col("_p.visibility") == "HiddenInViewMode", F.lit(False)).alias("hidden"),
        F.when(F.col("_p.width") > 0, F.col("_p.width")).otherwise(F.lit(width)).alias("width"),
        F.when(F.col("_p.height") > 0, F.col("_p.height")).otherwise(F.lit(height)).alias("height"),
        F.coalesce("visual_count", F.lit(0).cast("long")).alias("visual_count"),
    )


def on_listed_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of pages the report lists.  Applied to the small rows taken out of a visual, never to its text."""
    return rows.join(pages.select("report", "page_id"), ["report", "page_id"], "left_semi")


def parsed_visuals(files: DataFrame) -> DataFrame:
    """Readable visual files: ids, type, title, and the parsed body in ``_v``."""
    found = at(files, "visual").select(
        path_part("visual").alias("report"), path_part("visual", 2).alias("page_id"), path_part("visual", 3).alias("_folder"), "content"
    )
    readable = found.where(F.try_parse_json("content").isNotNull()).withColumn("_v", F.from_json("content", VISUAL))
    titles = F.filter(
        F.transform("_v.visual.visualContainerObjects.title", lambda t: t["properties"]["text"]["expr"]["Literal"]["Value"]),
        lambda t: t.isNotNull() & (t != ""),
    )
    title = F.regexp_replace(F.get(titles, F.lit(0)), "^'(.*)'$", "$1")
    kind = F.coalesce(F.nullif("_v.visual.visualType", F.lit("")), F.lit("unknown"))
    return readable.select(
        "report", "page_id", F.coalesce(F.nullif("_v.name", F.lit("")), "_folder").alias("visual_id"), kind.alias("visual_type"),
        F.coalesce(F.nullif(title, F.lit("")), kind).alias("title"), "_v", "content",
    )


def visual_rows(visuals: DataFrame) -> DataFrame:
    position, zero = F.col("_v.position"), F.lit(0.0)
    width, height = P.DEFAULT_VISUAL_SIZE
    return visuals.select(
        "report", "page_id", "visual_id", "visual_type", "title", *[F.coalesce(position[a], zero).alias(a) for a in ("x", "y", "z")],
        F.when(position["width"] > 0, position["width"]).otherwise(F.lit(width)).alias("width"),
        F.when(position["height"] > 0, position["height"]).otherwise(F.lit(height)).alias("height"),
    )


def field_ref(field: Column) -> Column:
    """``struct<field_type, table_name, field_name>`` of a field reference; null when it is none."""

    def ref(kind: str, owner: Column) -> Column:
        entity = F.coalesce(owner["Expression"]["SourceRef"]["Entity"], F.lit(""))
        made = F.struct(F.lit(kind).alias("field_type"), entity.alias("table_name"), owner["Property"].alias("field_name"))
        return F.when(owner.isNotNull(), made)

    level = field["HierarchyLevel"]
    entity = level["Expression"]["Hierarchy"]["Expression"]["SourceRef"]["Entity"]
    hierarchy = F.when(
        (F.coalesce(entity, F.lit("")) != "") & (F.coalesce(level["Level"], F.lit("")) != ""),
        F.struct(F.lit("column").alias("field_type"), entity.alias("table_name"), level["Level"].alias("field_name")),
    )
    return F.coalesce(ref("measure", field["Measure"]), ref("column", field["Column"]), ref("aggregation", field["Aggregation"]["Expression"]["Column"]), hierarchy)


VISUAL_KEYS = ["report", "page_id", "visual_id", "visual_type", "title"]


def _bindings(df: DataFrame, role: Column, field: Column, seq: Column) -> DataFrame:
    found = df.select(*VISUAL_KEYS, role.alias("role"), seq.cast("long").alias("seq"), field_ref(field).alias("_f"))
    return found.where(F.col("_f").isNotNull()).select("report", "seq", "page_id", "visual_id", "visual_type", "title", "role", "_f.*")


def _placed(role: Column, field: Column) -> Column:
    return F.struct(role.alias("role"), field.alias("field"))


def _in_wells() -> Column:
    """Fields in the wells of a visual, in order; the well is the role."""

    def well(entry: Column) -> Column:
        return F.transform(entry["value"]["projections"], lambda p: _placed(entry["key"], p["field"]))

    wells = F.filter(F.map_entries("_v.visual.query.queryState"), lambda e: e["value"]["projections"].isNotNull())
    return F.flatten(F.transform(wells, well))


def _in_filters() -> Column:
    return F.transform("_v.filterConfig.filters", lambda p: _placed(F.lit("Filter"), p["field"]))


def _exploded(visuals: DataFrame, *places: Column) -> DataFrame:
    """All places in one pass, so a visual is parsed once for them; numbered by their position in all of them."""
    none = F.array().cast(f"array<struct<role: string, field: {FIELD}>>")
    each = visuals.select(*VISUAL_KEYS, F.posexplode(F.concat(*[F.coalesce(p, none) for p in places])).alias("_seq", "_p"))
    return _bindings(each, F.col("_p.role"), F.col("_p.field"), F.col("_seq"))


def projection_bindings(visuals: DataFrame) -> DataFrame:
    return _exploded(visuals, _in_wells())


def filter_bindings(visuals: DataFrame) -> DataFrame:
    return _exploded(visuals, _in_filters())


def formatting_bindings(visuals: DataFrame) -> DataFrame:
    """Field references anywhere below a visual's ``objects``; the object is the role.

    A round checks LEVELS nesting levels and replaces the nodes by their children; only nodes whose text still holds an
    ``expr`` go on, so a round sees little and the loop ends with the deepest reference.
    """
    spark = visuals.sparkSession
    objects = visuals.where(F.col("content").contains('"objects"')).select(
        *VISUAL_KEYS, F.try_variant_get(F.parse_json("content"), "$.visual.objects", "variant").alias("_node")
    )
    level = spark.sql("select v.* except (_node), e.key as _role, e.pos as _at, e.value as _node from {v} v, lateral variant_explode(v._node) e", v=objects)
    found = None
    while True:
        seen = Observation()
        # Variants cannot be checkpointed in every format, their text can.
        texts = level.withColumn("_node", F.to_json("_node")).where(F.col("_node").contains('"expr"'))
        texts = checkpoint(texts.observe(seen, F.count(F.lit(1)).alias("n")))
        level = texts.withColumn("_node", F.parse_json("_node"))
        for _ in range(LEVELS):
            expr = F.from_json(F.to_json(F.try_variant_get("_node", "$.expr", "variant")), FIELD)
            here = _bindings(level, F.col("_role"), expr, F.lit(FORMATTING) + F.col("_at"))
            found = here if found is None else found.unionByName(here)
            level = spark.sql("select v.* except (_node), e.value as _node from {v} v, lateral variant_explode(v._node) e", v=level)
        if seen.get["n"] == 0:
            return found


def binding_rows(visuals: DataFrame) -> DataFrame:
    return _exploded(visuals, _in_wells(), _in_filters()).unionByName(formatting_bindings(visuals))
