"""The corpus: project files as rows ``(workspace, path, content)``, the roots in it and the report-to-model pairs.

A workspace is what a user would load at once; names are only compared inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.session import checkpoint

# What is read and what is skipped
EXTENSIONS = ["tmdl", "json", "bim", "pbir"]
SKIPPED_FOLDERS = r"\.pbi|\.git|node_modules|\.vs.*"
REPORT_ROOT = r"(?i)^(.*?/[^/]*\.Report)/"
REPORT_SUFFIX, MODEL_SUFFIX = r"(?i)\.Report$", r"(?i)\.SemanticModel$"
PLACES = {  # kind of a project file by its path
    "pointer": r"^(.*)/definition\.pbir$",
    "pages": r"^(.*)/definition/pages/pages\.json$",
    "page": r"^(.*)/definition/pages/([^/]+)/page\.json$",
    "visual": r"^(.*)/definition/pages/([^/]+)/visuals/([^/]+)/visual\.json$",
    "table": r"^(.*)/definition/tables/[^/]+\.tmdl$",
    "relationships": r"^(.*)/definition/relationships\.tmdl$",
    "expressions": r"^(.*)/definition/expressions\.tmdl$",
    "functions": r"^(.*)/definition/functions\.tmdl$",
    "model": r"^(.*)/definition/model\.tmdl$",
    "database": r"^(.*)/definition/database\.tmdl$",
    "culture": r"^(.*)/definition/cultures/([^/]+)\.tmdl$",
    "bim": r"^(.*?)(?:/definition)?/model\.bim$",
}
POINTER_PATH = r'"path"\s*:\s*("(?:[^"\\]++|\\.)*+")'


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri)) if "://" in uri else (fs.LocalFileSystem(), uri)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder: folders to go into and files to read, or an error in place of a listing."""
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            system, folder = _opened(uri)
            prefix = uri[: len(uri) - len(folder)] if uri.endswith(folder) else ""
            found, error = [], None
            try:
                for item in system.get_file_info(fs.FileSelector(folder)):
                    if item.type == fs.FileType.Directory and not re.fullmatch(SKIPPED_FOLDERS, item.base_name):
                        found.append((prefix + item.path, True, None))
                    elif item.type == fs.FileType.File and item.base_name.lower().endswith(tuple("." + e for e in EXTENSIONS)):
                        found.append((prefix + item.path, False, None))
            except OSError as problem:
                error = str(problem)
            if error is not None:
                found = [(uri, False, error)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], ["uri", "folder", "error"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each file, or the error that kept it from being read."""
    for batch in batches:
        for uri, error in zip(batch.column("uri").to_pylist(), batch.column("error").to_pylist(), strict=True):
            text = None
            if error is None:
                try:
                    system, place = _opened(uri)
                    with system.open_input_stream(place) as f:
                        text = f.read().decode("utf-8", "replace").removeprefix("\ufeff")
                except OSError as problem:
                    error = str(problem)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (uri, text, error)], ["path", "content", "error"])


def walk_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace, path, content, error)``: every project file below ``root``, whatever its name, and one row with an error for each file or
    folder that can't be read.

    Tasks list the folders, one level of the tree a round, and open the files; the driver sees neither.  The workspace is the first folder.
    """
    level = spark.createDataFrame([(root.rstrip("/"),)], "uri string")
    rounds = []
    while not level.isEmpty():
        spread = level.repartition(spark.sparkContext.defaultParallelism, "uri")
        found = checkpoint(spread.mapInArrow(_entries, "uri string, folder boolean, error string"))
        rounds.append(found.where(~F.col("folder")))
        level = found.where("folder").select("uri")
    listed = reduce(DataFrame.unionByName, rounds)
    # Dealt by name, so that one large folder is read by many tasks.
    read = listed.select("uri", "error").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri").mapInArrow(_contents, "path string, content string, error string")
    base = F.lit(root.rstrip("/") + "/")
    below = F.when(F.startswith("path", base), F.substring(F.col("path"), F.length(base) + 1, F.length("path")))
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return read.select(F.substring_index(F.coalesce(below, "path"), "/", 1).alias("workspace"), plain.alias("path"), "content", "error")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every readable project file below ``root``, one row each; ``unreadable`` tells of the others."""
    return walk_corpus(spark, root).where(F.col("error").isNull()).drop("error")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace, path, error)``: files and folders below ``root`` that could not be read."""
    return walk_corpus(spark, root).where(F.col("error").isNotNull()).select("workspace", "path", "error")


def place(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(pattern), name) for name, pattern in PLACES.items()], F.lit("other"))


def at(files: DataFrame, name: str) -> DataFrame:
    """The files of one place; on a staged corpus this reads one folder of it."""
    return files.where(F.col("place") == name if "place" in files.columns else F.col("path").rlike(PLACES[name]))


def path_part(name: str, group: int = 1) -> Column:
    return F.regexp_extract("path", PLACES[name], group)


def stage(files: DataFrame, folder: str) -> DataFrame:
    """Write the corpus once, one folder per place, and return it: every reader then opens only the files it parses."""
    files.withColumn("place", place(F.col("path"))).write.mode("overwrite").partitionBy("place").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column, suffix: str) -> Column:
    return F.regexp_replace(base_name(path), suffix, "")


def roots(files: DataFrame) -> DataFrame:
    """``(workspace, kind, root)`` for every folder named ``*.Report`` or ``*.SemanticModel`` at any depth."""
    folders = F.split(parent(F.col("path")), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
    named = F.filter(upto, lambda folder: folder.rlike(REPORT_SUFFIX) | folder.rlike(MODEL_SUFFIX))
    each = files.select("workspace", F.explode(named).alias("root"))
    kind = F.when(F.col("root").rlike(REPORT_SUFFIX), "report").when(F.col("root").rlike(MODEL_SUFFIX), "model")
    return each.distinct().select("workspace", kind.alias("kind"), "root")


def shallowest_report(files: DataFrame) -> DataFrame:
    """Per workspace its report root with the shortest path."""
    reports = roots(files).where(F.col("kind") == "report")
    return reports.groupBy("workspace").agg(F.min_by("root", F.struct(F.length("root"), F.col("root"))).alias("root"))


def pointers(files: DataFrame) -> DataFrame:
    """``(workspace, report, pointer, paths)``: what ``definition.pbir`` names as its model; broken files name nothing."""
    held = at(files, "pointer").where(F.try_parse_json("content").isNotNull())
    found = F.concat(F.lit("["), F.array_join(F.regexp_extract_all("content", F.lit(POINTER_PATH), F.lit(1)), ","), F.lit("]"))
    paths = F.filter(F.from_json(found, "array<string>"), lambda p: p != "")
    named = F.get_json_object("content", "$.datasetReference.byPath.path")
    last = F.regexp_extract(named, r"([^/\\]*)$", 1)
    return held.select("workspace", parent(F.col("path")).alias("report"), last.alias("pointer"), paths.alias("paths"))


def pairs_by_name(files: DataFrame) -> DataFrame:
    """Best model of every report: ``(workspace, report, model, reason, expected)``.

    The pointer decides when it names a model of the workspace; else equal names before the suffix; else no model and
    the name that was expected.
    """
    found = roots(files)
    reports = found.where(F.col("kind") == "report").select("workspace", F.col("root").alias("report"))
    models = found.where(F.col("kind") == "model").select("workspace", F.col("root").alias("model"))
    # The first of several models with one name, in path order.
    by_name = models.groupBy("workspace", F.lower(base_name(F.col("model"))).alias("_name")).agg(F.min("model").alias("_pointed"))
    by_stem = models.groupBy("workspace", F.lower(stem(F.col("model"), MODEL_SUFFIX)).alias("_stem")).agg(F.min("model").alias("_named"))
    known = reports.join(pointers(files).select("workspace", "report", "pointer"), ["workspace", "report"], "left")
    keyed = known.withColumns({"_name": F.lower("pointer"), "_stem": F.lower(stem(F.col("report"), REPORT_SUFFIX))})
    both = keyed.join(by_name, ["workspace", "_name"], "left").join(by_stem.where(F.col("_stem") != ""), ["workspace", "_stem"], "left")
    expected = F.when(F.coalesce("pointer", F.lit("")) != "", F.col("pointer")).otherwise(
        F.concat(stem(F.col("report"), REPORT_SUFFIX), F.lit(".SemanticModel"))
    )
    reason = F.when(F.col("_pointed").isNotNull(), "pbir").when(F.col("_named").isNotNull(), "prefix").otherwise("mismatch")
    return both.select("workspace", "report", F.coalesce("_pointed", "_named").alias("model"), reason.alias("reason"), expected.alias("expected"))


def reports_for_models(files: DataFrame) -> DataFrame:
    """Best report of every model: one that points at it (equal name first), else one of equal name."""
    found = roots(files)
    models = found.where(F.col("kind") == "model").select("workspace", F.col("root").alias("model"))
    reports = found.where(F.col("kind") == "report").select("workspace", F.col("root").alias("report"))
    report_stem = F.lower(stem(F.col("report"), REPORT_SUFFIX))
    pointing = pointers(files).where(F.coalesce("pointer", F.lit("")) != "").groupBy("workspace", F.lower("pointer").alias("_name")).agg(
        F.min_by("report", F.struct(report_stem != F.lower(F.regexp_replace("pointer", MODEL_SUFFIX, "")), F.col("report"))).alias("_points")
    )
    named = reports.groupBy("workspace", report_stem.alias("_stem")).agg(F.min("report").alias("_named"))
    keyed = models.withColumns({"_name": F.lower(base_name(F.col("model"))), "_stem": F.lower(stem(F.col("model"), MODEL_SUFFIX))})
    both = keyed.join(pointing, ["workspace", "_name"], "left").join(named, ["workspace", "_stem"], "left")
    return both.select("workspace", "model", F.coalesce("_points", "_named").alias("report"))


def default_pair(files: DataFrame) -> DataFrame:
    """Per workspace the pair to load first: the first report by name with its best model, else the first model."""
    found = roots(files)

    def first(kind: str, name: str) -> DataFrame:
        return found.where(F.col("kind") == kind).groupBy("workspace").agg(
            F.min_by("root", F.struct(base_name(F.col("root")), F.col("root"))).alias(name)
        )

    matched = pairs_by_name(files).select("workspace", "report", F.col("model").alias("_best"))
    both = first("report", "report").join(first("model", "_first"), "workspace", "full_outer").join(matched, ["workspace", "report"], "left")
    return both.select("workspace", "report", F.coalesce("_best", "_first").alias("model"))


def normalized(path: Column) -> Column:
    """``a/b/../c`` and ``./`` resolved, segment by segment."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), empty, step), "/"))


def pairs_on_disk(files: DataFrame) -> DataFrame:
    """Model every report uses as stored: ``(workspace, report, model, reason)``.

    A pointer path that leads to a model, from the report's folder or from its parent; else a model beside the report:
    of equal name, of the shortest name that starts with the report's, or the first.  Each way is an equi-join: for
    the prefixes, every model offers all prefixes of its name.
    """
    found = roots(files)
    reports = found.where(F.col("kind") == "report").select("workspace", F.col("root").alias("report"))
    models = found.where(F.col("kind") == "model").select("workspace", F.col("root").alias("model"))
    tried = pointers(files).select("workspace", "report", F.posexplode("paths").alias("_n", "_path"))
    ways = F.array(*[
        F.struct((F.col("_n") * 2 + n).alias("n"), normalized(F.concat_ws("/", base, F.col("_path"))).alias("model"))
        for n, base in enumerate((F.col("report"), parent(F.col("report"))))
    ])
    resolved = tried.select("workspace", "report", F.explode(ways).alias("_w")).select("workspace", "report", "_w.*").join(
        models, ["workspace", "model"], "left_semi"
    )
    pointed = resolved.groupBy("workspace", "report").agg(F.min_by("model", "n").alias("_pointed"))

    name = base_name(F.col("model"))
    beside = models.where(F.col("model").endswith(".SemanticModel")).select("workspace", parent(F.col("model")).alias("_dir"), "model", name.alias("_model"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("_model")), lambda n: F.left("_model", n))
    starting = beside.select("workspace", "_dir", "model", "_model", F.explode(prefixes).alias("_stem")).groupBy("workspace", "_dir", "_stem").agg(
        F.min_by("model", F.struct(F.length("_model"), F.col("_model"))).alias("_starts")
    )
    first = beside.groupBy("workspace", "_dir").agg(F.min("model").alias("_first"))
    exact = beside.select("workspace", "_dir", F.regexp_replace("_model", r"\.SemanticModel$", "").alias("_stem"), F.col("model").alias("_exact"))
    keyed = reports.withColumns({"_dir": parent(F.col("report")), "_stem": stem(F.col("report"), REPORT_SUFFIX)})
    joined = (
        keyed.join(pointed, ["workspace", "report"], "left").join(exact, ["workspace", "_dir", "_stem"], "left")
        .join(starting, ["workspace", "_dir", "_stem"], "left").join(first, ["workspace", "_dir"], "left")
    )
    ways = ["_pointed", "_exact", "_starts", "_first"]
    reason = F.coalesce(*[F.when(F.col(w).isNotNull(), label) for w, label in zip(ways, ("pbir", "exact", "prefix", "first"))], F.lit("none"))
    return joined.select("workspace", "report", F.coalesce(*ways).alias("model"), reason.alias("reason"))


def projects(files: DataFrame, on_disk: bool = True) -> DataFrame:
    """``(model_id, workspace, report, model, mode)``: every report with its model, and models no report uses.

    A report-only or model-only project keeps the missing half null: its tables come out empty.
    """
    matched = pairs_on_disk(files) if on_disk else pairs_by_name(files)
    models = roots(files).where(F.col("kind") == "model").select("workspace", F.col("root").alias("model"))
    both = matched.select("workspace", "report", "model").join(models, ["workspace", "model"], "full_outer")
    mode = F.when(F.col("report").isNull(), "model-only").when(F.col("model").isNull(), "report-only").otherwise("full")
    return both.select(F.coalesce("report", "model").alias("model_id"), "workspace", "report", "model", mode.alias("mode"))
