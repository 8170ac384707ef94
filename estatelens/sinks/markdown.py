"""Markdown sink: every document is a frame of ordered lines, written without ever gathering a document.

A line is ``(model_id, doc, section, key1, key2, line)``; the writer range-sorts by these and makes one file of each document.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from estatelens.functions import text
from estatelens.session import checkpoint

#: Bytes copied at once when a document is put together.
COPIED = 4 * 1024 * 1024

LINE_COLUMNS = ["model_id", "doc", "section", "key1", "key2", "line"]


def table_row(*cells: Column) -> Column:
    """One pipe-table row; pipes are escaped, line breaks become blanks."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[text.markdown_cell(c.cast("string")) for c in cells]), F.lit(" |"))


def link(label: Column, doc: str, heading: Column) -> Column:
    """A link to the heading or anchor of that name in a document."""
    return F.concat(F.lit("["), label, F.lit(f"]({doc}.md#"), text.wiki_slug(heading), F.lit(")"))


def anchor(name: Column) -> Column:
    return F.concat(F.lit('<a id="'), text.wiki_slug(name), F.lit('"></a>'))


def rows(df: DataFrame, doc: str, section: int, line: Column, key1: Column, key2: Column | None = None) -> DataFrame:
    second = F.lit("") if key2 is None else key2.cast("string")
    return df.select(
        "model_id", F.lit(doc).alias("doc"), F.lit(section).alias("section"), key1.cast("string").alias("key1"), second.alias("key2"),
        line.alias("line"),
    )


def fixed(models: DataFrame, doc: str, section: int, *lines: str) -> DataFrame:
    """Lines every model's document has: headings and table heads."""
    each = models.select("model_id", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("_n", "line"))
    return each.select("model_id", F.lit(doc).alias("doc"), F.lit(section).alias("section"), F.lit("").alias("key1"),
                       F.lpad(F.col("_n").cast("string"), 4, "0").alias("key2"), "line")


def padded(number: Column) -> Column:
    """Numbers as sort keys."""
    return F.lpad(number.cast("string"), 12, "0")


def table(models: DataFrame, df: DataFrame, doc: str, section: int, title: str, heads: list[str], cells: list[Column],
          key1: Column, key2: Column | None = None) -> DataFrame:
    head = fixed(models, doc, section, f"## {title}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads))
    return head.unionByName(rows(df, doc, section + 1, table_row(*cells), key1, key2))


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*LINE_COLUMNS[:-1], "line")


def place(model_id: str, doc: str) -> str:
    """A document's path below the output folder."""
    return f"model_id={quote(model_id or '', safe='')}/{quote(doc, safe='')}.md"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (model_id, doc, part, path) of each chunk."""

    chunks: list[tuple]


class ChunkWriter(DataSourceWriter):
    """Streams a task's ordered lines into one file for each document it meets."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        # A name of the attempt's own: what a failed or doubled attempt left is never read.
        context, chunks, out, own = TaskContext.get(), [], None, None
        system, root = opened(f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}")
        for row in iterator:
            key = (row["model_id"], row["doc"])
            if key != own:
                if out is not None:
                    out.close()
                own, path = key, f"{root}/{place(*key)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path)
                chunks.append((*key, context.partitionId(), path))
            out.write((row["line"] or "").encode() + b"\n")
        if out is not None:
            out.close()
        return Written(chunks)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        # Paths of committed tasks only: at most one for each task and document.
        system, root = opened(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/chunks.json") as out:
            for message in messages:
                for model_id, doc, part, path in message.chunks if message is not None else ():
                    out.write(json.dumps({"model_id": model_id, "doc": doc, "part": part, "path": path}).encode() + b"\n")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class MarkdownChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "estate_markdown"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(self.options["path"])


def _assembled(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, root = opened(path)
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            name = f"{root}/{place(row['model_id'], row['doc'])}"
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            draft = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                for part in row["parts"]:
                    with system.open_input_stream(part["path"]) as chunk:
                        while data := chunk.read(COPIED):
                            out.write(data)
            system.move(draft, name)
            done.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("model_id"), batch.column("doc"), pa.array(done, pa.string())], ["model_id", "doc", "path"])


def write_markdown(lines: DataFrame, path: str) -> DataFrame:
    """One file for every model and document, ``path/model_id=<model>/<doc>.md``; returns ``(model_id, doc, path)``.

    Tasks stream their range of the sorted lines into chunk files, a file per document they meet; only chunks of committed tasks count.
    A document whose lines lie in several ranges, however long, is then copied together piece by piece and appears under its name at once.  Other files
    below ``path`` stay as they are.
    """
    spark, staging = lines.sparkSession, f"{path.rstrip('/')}/_chunks-{uuid.uuid4().hex}"
    spark.dataSource.register(MarkdownChunks)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)  # sources are looked up in the thread's session
    ordered(lines).select("model_id", "doc", "line").write.format("estate_markdown").mode("append").option("path", staging).save()
    chunks = spark.read.schema("model_id string, doc string, part int, path string").json(f"{staging}/chunks.json")
    whole = chunks.groupBy("model_id", "doc").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).alias("parts"))  # at most one for each task
    done = checkpoint(whole.mapInArrow(partial(_assembled, path), "model_id string, doc string, path string"))
    system, root = opened(staging)
    system.delete_dir(root)
    return done
