"""From a corpus of project files to an estate."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.estate import SCHEMAS, Estate
from estatelens.session import ensure_checkpoint_dir
from estatelens.sources import bim, blocks, report
from estatelens.sources import files as corpus

MODEL_TABLES = ["models", "tables", "columns", "measures", "relationships", "partitions", "hierarchies", "expressions", "functions", "calc_items"]


def formats(files: DataFrame) -> DataFrame:
    """``(root, format)`` per model folder: text blocks when a table file exists, else the JSON file, else none."""
    path, kind = F.col("path"), r"(?i)^(.*?/[^/]*\.SemanticModel)/"
    each = files.where(path.rlike(kind)).select(F.regexp_extract("path", kind, 1).alias("root"), corpus.place(path).alias("_place"))
    each = each.withColumns({"_text": F.col("_place") == "table", "_json": F.col("_place") == "bim"})
    chosen = F.when(F.bool_or("_text"), "tmdl").when(F.bool_or("_json"), "bim").otherwise("none")
    return each.groupBy("root").agg(chosen.alias("format"))


#: What keeps a parsed frame: (frame, name, column that most readers filter by).
Keep = Callable[[DataFrame, str, str | None], DataFrame]


def lazily(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Nothing is written; each reader parses for itself."""
    return df


def kept_in(folder: str) -> Keep:
    """Parsed frames are written below ``folder`` once, in columns and by the word that readers ask for, so each reader opens its part of what was parsed."""

    def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns)

    return keep


def model_frames(files: DataFrame, keep: Keep = lazily) -> dict[str, DataFrame]:
    """Every model table keyed by the model's folder, text and JSON models together; each file is parsed once where ``keep`` writes."""
    sections = keep(blocks.table_sections(files), "sections", None)
    found = keep(blocks.members(sections), "members", "word")
    text = {
        "models": blocks.models(files), "tables": blocks.tables(sections), "columns": blocks.columns(found), "measures": blocks.measures(found),
        "relationships": blocks.relationships(files), "partitions": blocks.partitions(found), "hierarchies": blocks.hierarchies(found),
        "expressions": blocks.expressions(files), "functions": blocks.functions(files), "calc_items": blocks.calc_items(found),
    }
    whole = keep(bim.parsed(files), "json-models", None)
    chosen = formats(files)
    as_text = chosen.where(F.col("format") == "tmdl").select("root")
    as_json = chosen.where(F.col("format") == "bim").select("root")
    frames = {}
    for name in MODEL_TABLES:
        json = getattr(bim, name)(whole).join(as_json, "root", "left_semi")
        frames[name] = text[name].join(as_text, "root", "left_semi").unionByName(json)
    return frames


def read_estate(spark: SparkSession, folder: str, staging: str | None = None) -> Estate:
    """Read every project below ``folder``.

    The corpus is read once and staged by kind of file, under ``staging`` or in the checkpoint folder, since a dozen
    readers each want a small part of it; what several readers take out of the same files is parsed once and written beside it.
    """
    ensure_checkpoint_dir(spark)
    staging = staging.rstrip("/") if staging else f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    return estate_of(corpus.stage(corpus.read_corpus(spark, folder), staging), kept_in(f"{staging}-parsed"))


def estate_of(files: DataFrame, keep: Keep = lazily) -> Estate:
    """The estate of a corpus: each project is a report with its model; a missing half gives empty tables.

    Write it out with ``sinks.tables.write_tables`` and read it back with ``Estate.read``, so the text is parsed once.
    """
    projects = corpus.projects(files)
    used = projects.where(F.col("model").isNotNull()).select("model_id", F.col("model").alias("root"))
    reports = projects.where(F.col("report").isNotNull()).select("model_id", "report")
    frames = {name: df.join(used, "root").drop("root") for name, df in model_frames(files, keep).items()}
    pages, visuals = report.page_rows(files), keep(report.parsed_visuals(files), "visuals", None)
    taken = {"pages": pages.drop("visual_count")}
    taken["visuals"] = report.on_listed_pages(report.visual_rows(visuals), pages)
    taken["bindings"] = report.on_listed_pages(report.binding_rows(visuals), pages)
    frames.update({name: df.join(reports, "report").drop("report") for name, df in taken.items()})

    def shaped(name: str) -> DataFrame:
        wanted = files.sparkSession.createDataFrame([], SCHEMAS[name]).schema
        return frames[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

    return Estate(files.sparkSession, {name: shaped(name) for name in frames})
