"""The estate: the record sets every operator works on, as lazy DataFrames keyed by ``model_id``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beside a table's files, out of sight of readers of the folder.
MANIFEST = "_manifest"
SCHEMAS = {
    "models": "model_id string, name string, description string, culture string, source_query_culture string, cultures array<string>,"
    " compatibility_level int, discourage_implicit boolean, value_filter string, data_source_version string",
    "tables": "model_id string, table_name string, description string, is_calc_group boolean",
    "columns": "model_id string, table_name string, name string, data_type string, description string, is_key boolean, is_hidden boolean,"
    " is_calculated boolean, has_param_metadata boolean, summarize_by string, sort_by_column string, data_category string,"
    " format_string string, display_folder string",
    "measures": "model_id string, table_name string, name string, body string, format_string string, description string, display_folder string",
    "relationships": "model_id string, rel_no bigint, from_table string, from_column string, to_table string, to_column string,"
    " is_active boolean, from_card string, to_card string, cross_filter string",
    "partitions": "model_id string, table_name string, part_no int, name string, mode string, kind string, expression_source string, m_body string",
    "hierarchies": "model_id string, table_name string, hierarchy string, level_no int, level string, column_name string, description string",
    "expressions": "model_id string, name string, kind string, value string, metadata string, description string",
    "functions": "model_id string, name string, parameters string, body string, description string",
    "calc_items": "model_id string, group_name string, precedence int, ordinal int, name string, body string, format_expr string, description string",
    "pages": "model_id string, page_id string, page_no bigint, name string, hidden boolean, width double, height double",
    "visuals": "model_id string, page_id string, visual_id string, visual_type string, title string, x double, y double, z double,"
    " width double, height double",
    "bindings": "model_id string, seq bigint, page_id string, visual_id string, visual_type string, title string, role string,"
    " field_type string, table_name string, field_name string",
}


class Estate:
    """Named DataFrames; each may be given as a frame or as a function that builds it on first use."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(frames) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown estate tables: {sorted(unknown)}")
        self.spark = spark
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        frame = self._frames.get(name)
        if frame is None:  # a missing half of a project is an empty input, not a failure
            frame = self.spark.createDataFrame([], SCHEMAS[name])
        elif callable(frame):
            frame = frame()
        self._frames[name] = frame
        return frame

    def replace(self, **frames: DataFrame | Callable[[], DataFrame]) -> Estate:
        return Estate(self.spark, {**self._frames, **frames})

    @classmethod
    def derived(cls, spark: SparkSession, sf_dir: str) -> Estate:
        """The estate derived from the TPC-H-like tables in ``sf_dir`` (see ``plans/derived.py``)."""
        from estatelens.plans.derived import spark_view

        def table(name: str, view: str) -> Callable[[], DataFrame]:
            def build() -> DataFrame:
                df = spark_view(spark, sf_dir, view).withColumn("model_id", F.lit("m0"))
                if name == "tables":
                    df = df.withColumn("is_calc_group", F.col("table_name").startswith("CG"))
                if name == "models":
                    df = (
                        df.withColumn("cultures", F.array("culture")).withColumn("source_query_culture", F.lit(""))
                        .withColumn("data_source_version", F.lit(""))
                    )
                if name == "measures":
                    df = df.drop("measure_id")
                return df

            return build

        views = {
            "models": "x_models", "tables": "x_tables", "columns": "x_columns", "measures": "e_measures", "relationships": "x_rels",
            "partitions": "x_partitions", "hierarchies": "x_hierarchies", "expressions": "x_expressions", "functions": "x_functions",
            "calc_items": "x_calc_items", "pages": "x_pages", "visuals": "x_visuals", "bindings": "x_bindings",
        }
        return cls(spark, {name: table(name, view) for name, view in views.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str, models: Sequence[str] | None = None) -> Estate:
        """An estate saved with :func:`estatelens.sinks.tables.write_tables`; of ``models`` alone, only files whose range holds one of them are opened."""

        def whole(name: str) -> DataFrame:
            return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

        def some(name: str) -> DataFrame:
            manifest = spark.read.parquet(f"{folder}/{name}/{MANIFEST}")
            inside = reduce(Column.__or__, [F.lit(m).between(F.col("low"), F.col("high")) for m in models], F.lit(False))
            files = [r["file"] for r in manifest.where(inside).select("file").collect()]  # a few files for each model asked for
            found = spark.read.schema(SCHEMAS[name]).parquet(*files) if files else spark.createDataFrame([], SCHEMAS[name])
            return found.where(F.col("model_id").isin(list(models)))

        def table(name: str) -> Callable[[], DataFrame]:
            return lambda: whole(name) if models is None else some(name)

        return cls(spark, {name: table(name) for name in SCHEMAS})
