"""CSV exports: the rows a reader exports from the lists, and the writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.estate import Estate
from estatelens.functions.text import yes_no
from estatelens.operators.lineage import matching, unused_only


def measure_rows(estate: Estate, statuses: DataFrame, query: str = "", unused: bool = False) -> DataFrame:
    keys = ["model_id", "table_name", "name"]
    rows = estate.measures.join(statuses, keys)
    if unused:
        rows = unused_only(rows)
    if query:
        rows = matching(rows, query, "name", "table_name", "body", "description")
    return rows.select(
        "model_id", F.col("name").alias("Measure"), F.col("table_name").alias("Table"), F.col("status").alias("Status"),
        F.col("usage_count").alias("Usage Count"), F.col("page_count").alias("Page Count"), F.col("display_folder").alias("Display Folder"),
        F.col("format_string").alias("Format String"), F.col("description").alias("Description"), F.col("body").alias("DAX"),
    )


def column_rows(estate: Estate, statuses: DataFrame, query: str = "", unused: bool = False) -> DataFrame:
    keys = ["model_id", "table_name", "name"]
    rows = estate.columns.join(statuses, keys)
    if unused:
        rows = unused_only(rows)
    if query:
        rows = matching(rows, query, "name", "table_name", "data_type")
    return rows.select(
        "model_id", F.col("name").alias("Column"), F.col("table_name").alias("Table"), F.col("data_type").alias("Data Type"),
        F.col("status").alias("Status"), F.col("usage_count").alias("Usage Count"), F.col("page_count").alias("Page Count"),
        yes_no(F.col("is_key")).alias("Is Key"), yes_no(F.col("is_hidden")).alias("Is Hidden"), yes_no(F.col("is_calculated")).alias("Is Calculated"),
        F.col("format_string").alias("Format String"), F.col("display_folder").alias("Display Folder"),
        F.col("sort_by_column").alias("Sort By Column"), F.col("description").alias("Description"),
    )


def relationship_rows(relationships: DataFrame) -> DataFrame:
    return relationships.select(
        "model_id", F.col("from_table").alias("From Table"), F.col("from_column").alias("From Column"), F.col("to_table").alias("To Table"),
        F.col("to_column").alias("To Column"), F.col("from_card").alias("From Cardinality"), F.col("to_card").alias("To Cardinality"),
        F.col("cross_filter").alias("Cross Filter"), yes_no(F.col("is_active")).alias("Active"),
    )


def source_map_rows(source_map: DataFrame, query: str = "", source_type: str = "") -> DataFrame:
    rows = source_map
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    if query:
        rows = matching(rows, query, "column", "table_name", "source_type", "source_location", "data_type")
    return rows.select(
        "model_id", F.col("column").alias("Column"), F.col("table_name").alias("Table"), F.col("data_type").alias("Data Type"),
        F.col("mode").alias("Mode"), F.col("source_type").alias("Source Type"), F.col("source_location").alias("Source Location"),
        yes_no(F.col("is_hidden")).alias("Hidden"), yes_no(F.col("is_calculated")).alias("Calculated"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180 quoting, one folder per model."""
    rows.write.mode("overwrite").partitionBy("model_id").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
