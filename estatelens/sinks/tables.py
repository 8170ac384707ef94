"""Parquet sink: every table of an estate in files clustered by model, with a manifest that tells which models a file holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.estate import MANIFEST, SCHEMAS, Estate


def write_table(df: DataFrame, path: str) -> None:
    """Ranges of models, so small models share a file and one with a third of all rows takes several; the number of files goes with the rows, not
    with the models.  The manifest is taken from the written files' own columns."""
    rest = [c for c in df.columns if c != "model_id"]
    clustered = df.repartitionByRange("model_id", F.xxhash64(*rest)).sortWithinPartitions("model_id")
    clustered.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    held = spark.read.schema(df.schema).parquet(path).groupBy(F.input_file_name().alias("file"))
    bounds = held.agg(F.min("model_id").alias("low"), F.max("model_id").alias("high"), F.count(F.lit(1)).alias("rows"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def write_tables(estate: Estate, folder: str) -> None:
    for name in SCHEMAS:
        write_table(getattr(estate, name), f"{folder}/{name}")
