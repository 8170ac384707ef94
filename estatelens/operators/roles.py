"""Tables and columns: origin, kind, keys, roles, groups and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions import patterns as P
from estatelens.operators import refs
from estatelens.operators.numbering import number_rows

# Display orders
ROLE_ORDER = ["Fact", "Bridge", "Dimension", "Disconnected", "Calculation Group"]
TABLE_GROUPS = ["data", "measure", "field-param", "proxy", "calcgroup"]
ER_GLYPHS = [("one", "one", "||--||"), ("many", "one", "}o--||"), ("one", "many", "||--o{"), ("many", "many", "}o--o{")]


def is_auto_date(table: Column) -> Column:
    return table.rlike(P.AUTO_DATE)


def origin(table: Column) -> Column:
    return F.when(is_auto_date(table), "auto-date").otherwise("user")


def without_calc_names(columns: DataFrame, calc_items: DataFrame) -> DataFrame:
    """Columns without the implicit ``Name`` column of calculation groups."""
    groups = calc_items.select("model_id", F.col("group_name").alias("table_name")).distinct()
    names = groups.withColumn("name", F.lit("Name"))
    return columns.join(names, ["model_id", "table_name", "name"], "left_anti")


def column_keys(columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """Columns with ``is_inferred_pk``, ``is_fk``, their foreign-key target and how many columns refer to them.

    Each side of the relationships is reduced to one row per column before the join; the last relationship of a
    column names its target.
    """
    target = F.max_by(F.struct(F.col("to_table").alias("fk_table"), F.col("to_column").alias("fk_column")), "rel_no")
    outgoing = relationships.groupBy("model_id", F.col("from_table").alias("table_name"), F.col("from_column").alias("name")).agg(
        target.alias("_fk")
    )
    incoming = relationships.groupBy("model_id", F.col("to_table").alias("table_name"), F.col("to_column").alias("name")).agg(
        F.count(F.lit(1)).alias("incoming_refs"), F.count_if(~F.col("is_active")).alias("inactive_refs")
    )
    keys = ["model_id", "table_name", "name"]
    return columns.join(outgoing, keys, "left").join(incoming, keys, "left").select(
        *columns.columns, F.col("incoming_refs").isNotNull().alias("is_inferred_pk"), F.col("_fk").isNotNull().alias("is_fk"),
        F.col("_fk.fk_table").alias("fk_table"), F.col("_fk.fk_column").alias("fk_column"),
        F.coalesce("incoming_refs", F.lit(0).cast("long")).alias("incoming_refs"),
        F.coalesce("inactive_refs", F.lit(0).cast("long")).alias("inactive_refs"),
    )


def incoming_refs(columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per column and column that refers to it."""
    sides = relationships.select(
        "model_id", F.col("to_table").alias("table_name"), F.col("to_column").alias("name"), "from_table", "from_column", "is_active"
    )
    return columns.select("model_id", "table_name", "name").join(sides, ["model_id", "table_name", "name"])


def constraints() -> Column:
    """Short constraint text of a column: PK / PK* / FK target / referring columns / CALC / HIDDEN."""
    fk = F.concat(F.lit("FK → "), "fk_table", F.lit("["), "fk_column", F.lit("]"))
    refs_text = F.concat(F.lit("Ref ← "), F.col("incoming_refs").cast("string"))
    parts = [
        F.when(F.col("is_key"), "PK").when(F.col("is_inferred_pk"), "PK*"), F.when(F.col("is_fk"), fk),
        F.when(F.col("incoming_refs") > 0, refs_text), F.when(F.col("is_calculated"), "CALC"), F.when(F.col("is_hidden"), "HIDDEN"),
    ]
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", F.lit("—")).otherwise(text)


def column_order() -> list[Column]:
    """Primary keys, then foreign keys, then names."""
    return [(~(F.col("is_key") | F.col("is_inferred_pk"))).asc(), (~F.col("is_fk")).asc(), F.col("name").asc()]


def numbered_columns(columns: DataFrame, relationships: DataFrame) -> DataFrame:
    return number_rows(column_keys(columns, relationships), ["model_id", "table_name"], column_order(), "column_no")


def partition_facts(partitions: DataFrame) -> DataFrame:
    """Per table what its partitions say: calculated, direct query, remote entity."""
    direct = F.lower("mode") == "directquery"
    return partitions.groupBy("model_id", "table_name").agg(
        F.count(F.lit(1)).alias("partition_count"), F.bool_or(F.col("kind") == "calculated").alias("has_calculated"),
        F.bool_or(F.col("mode") == "directQuery").alias("has_direct_query"),
        F.bool_or((F.col("mode") == "directQuery") & (F.coalesce("expression_source", F.lit("")) != "")).alias("has_remote_entity"),
        F.min(F.when(direct & (F.col("expression_source") != ""), F.col("expression_source"))).alias("remote_expression"),
    )


def table_degrees(relationships: DataFrame) -> DataFrame:
    """Outgoing and incoming relationships per table, inactive ones included."""
    ends = relationships.select(
        "model_id", F.explode(F.array(
            F.struct(F.col("from_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("to_table").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("_e"),
    )
    return ends.groupBy("model_id", F.col("_e.table_name").alias("table_name")).agg(
        F.sum("_e.o").alias("outgoing"), F.sum("_e.i").alias("incoming")
    )


def role() -> Column:
    return (
        F.when(F.col("origin") == "auto-date", "Auto-date").when(F.col("is_calc_group"), "Calculation Group")
        .when((F.col("outgoing") > 0) & (F.col("incoming") == 0), "Fact")
        .when((F.col("outgoing") == 0) & (F.col("incoming") > 0), "Dimension")
        .when((F.col("outgoing") > 0) & (F.col("incoming") > 0), "Bridge")
        .otherwise("Disconnected")
    )


def role_rank(column: str = "role") -> Column:
    chain = F.when(F.col(column) == ROLE_ORDER[0], 1)
    for n, name in enumerate(ROLE_ORDER[1:], start=2):
        chain = chain.when(F.col(column) == name, n)
    return chain.otherwise(len(ROLE_ORDER) + 1)


def table_summary(estate: Estate) -> DataFrame:
    """One row per table: origin, kind flags, counts, degrees and role."""
    columns = column_keys(without_calc_names(estate.columns, estate.calc_items), estate.relationships)
    per_table = columns.groupBy("model_id", "table_name").agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if(F.col("is_key") | F.col("is_inferred_pk")).alias("key_count"),
        F.count_if("is_fk").alias("fk_count"), F.count_if("is_hidden").alias("hidden_count"),
        F.count_if(F.col("name") == F.col("table_name")).alias("_self"), F.bool_or("has_param_metadata").alias("_param"),
    )
    measured = estate.measures.groupBy("model_id", "table_name").agg(F.count(F.lit(1)).alias("measure_count"))
    groups = estate.calc_items.select("model_id", F.col("group_name").alias("table_name")).distinct().withColumn("_group", F.lit(True))
    described = estate.tables.groupBy("model_id", "table_name").agg(F.max("description").alias("description"))
    keys = ["model_id", "table_name"]
    names = refs.table_names(estate.columns, estate.measures, estate.calc_items)
    joined = names
    for side in (per_table, measured, groups, described, partition_facts(estate.partitions), table_degrees(estate.relationships)):
        joined = joined.join(side, keys, "left")

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long")).alias(name)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    proxy = flag("has_remote_entity") & (F.coalesce("column_count", F.lit(0)) == 1) & (F.coalesce("_self", F.lit(0)) == 1)
    flat = joined.select(
        *keys, F.coalesce("description", F.lit("")).alias("description"), origin(F.col("table_name")).alias("origin"),
        flag("_group").alias("is_calc_group"), (flag("has_calculated") & ~flag("_group")).alias("is_calculated"),
        F.when(flag("_param"), "field").when(proxy, "compositeModelProxy").alias("parameter_kind"),
        zero("column_count"), zero("measure_count"), zero("key_count"), zero("fk_count"), zero("hidden_count"),
        zero("partition_count"), flag("has_direct_query").alias("has_direct_query"), "remote_expression",
        zero("outgoing"), zero("incoming"),
    )
    return flat.withColumn("role", role())


def table_group() -> Column:
    """Display group of a table; needs the columns of :func:`table_summary`."""
    measure_home = (F.col("measure_count") > 0) & (F.col("column_count") <= 1) & F.lower("table_name").contains("measure")
    return (
        F.when(F.col("parameter_kind") == "field", "field-param").when(F.col("parameter_kind") == "compositeModelProxy", "proxy")
        .when(F.col("is_calc_group"), "calcgroup").when(measure_home, "measure").otherwise("data")
    )


def role_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("model_id", "role").agg(F.count(F.lit(1)).alias("tables"))


def star_schema(summary: DataFrame) -> DataFrame:
    """Per model: tables per role among user tables, and whether they form a star."""
    user = summary.where(F.col("origin") == "user")
    n = {r: F.count_if(F.col("role") == r) for r in ("Fact", "Dimension", "Bridge", "Disconnected")}
    counts = user.groupBy("model_id").agg(*[c.cast("long").alias(r.lower()) for r, c in n.items()])
    return counts.withColumn("is_star", (F.col("bridge") == 0) & (F.col("disconnected") == 0) & (F.col("fact") > 0))


def group_rollup(summary: DataFrame) -> DataFrame:
    """Tables, columns and measures per display group and, in the ``all`` row, over all of them; auto-date left out."""
    visible = summary.where(F.col("origin") == "user").withColumn("table_group", table_group())
    cube = visible.rollup("model_id", "table_group").agg(
        F.grouping("model_id").alias("_gm"), F.grouping("table_group").alias("_gt"), F.count(F.lit(1)).alias("tables"),
        F.sum("column_count").alias("columns"), F.sum("measure_count").alias("measures"),
    )
    kept = cube.where(F.col("_gm") == 0)
    return kept.select("model_id", F.when(F.col("_gt") == 1, "all").otherwise(F.col("table_group")).alias("table_group"), "tables", "columns", "measures")


def relationship_counts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("model_id").agg(
        F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive")
    )


def fk_columns_per_dimension(relationships: DataFrame) -> DataFrame:
    """Star fragment edges: one row per (fact, dimension, column), with how many columns the pair has."""
    pair = ["model_id", "from_table", "to_table"]
    edges = relationships.select(*pair, "from_column").distinct()
    sizes = edges.groupBy(*pair).agg(F.count(F.lit(1)).alias("fk_columns"))
    return edges.join(sizes, pair)


def table_relationships(relationships: DataFrame) -> DataFrame:
    """Per table its outgoing and incoming relationships as readable rows."""
    mark = {c: F.when(F.col(c) == "many", "*").otherwise("1") for c in ("from_card", "to_card")}
    common = [
        F.concat(mark["from_card"], F.lit(":"), mark["to_card"]).alias("cardinality"),
        (F.col("cross_filter") == "bothDirections").alias("both_directions"), "is_active",
    ]

    def side(direction: str, own: str, other: str) -> DataFrame:
        return relationships.select(
            "model_id", F.col(f"{own}_table").alias("table_name"), F.lit(direction).alias("direction"),
            F.col(f"{own}_column").alias("own_column"), F.col(f"{other}_table").alias("other_table"),
            F.col(f"{other}_column").alias("other_column"), *common,
        )

    return side("outgoing", "from", "to").unionByName(side("incoming", "to", "from"))


def visible_edges(relationships: DataFrame, shown: DataFrame) -> DataFrame:
    """Relationships whose two tables are both shown."""
    names = shown.select("model_id", "table_name").distinct()
    return relationships.join(names.withColumnRenamed("table_name", "from_table"), ["model_id", "from_table"], "left_semi").join(
        names.withColumnRenamed("table_name", "to_table"), ["model_id", "to_table"], "left_semi"
    )


def er_edges(relationships: DataFrame, shown: DataFrame) -> DataFrame:
    """Diagram edges with crow's-foot glyph and label."""
    glyph = F.coalesce(*[F.when((F.col("from_card") == a) & (F.col("to_card") == b), g) for a, b, g in ER_GLYPHS], F.lit("}o--o{"))
    tag = F.when(F.col("cross_filter") == "bothDirections", "_bidi").when(~F.col("is_active"), "_inactive").otherwise("")
    return visible_edges(relationships, shown).select(
        "model_id", "from_table", glyph.alias("glyph"), "to_table", F.concat("from_column", tag).alias("label")
    )
