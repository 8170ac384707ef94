"""Reading tables, writing intermediate results to the shared folder, and columns as bytes inside tasks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

from estatelens.session import ensure_checkpoint_dir

#: Texts are worked on in slices of this many bytes, so that a batch of very long texts needs no more memory than one of short ones.
SLICE_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and later reads prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._settled = path
    return made


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that no frame still to be computed reads, and let go of the shuffle files of ended jobs."""
    for df in settled:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df._settled)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if settled:  # Spark's cleaner removes shuffles once the driver has collected what refers to them
        gc.collect()
        settled[0].sparkSession._jvm.System.gc()


def small_batches(spark: SparkSession, size: int = SLICE_BYTES) -> SparkSession:
    """Bounds what one Arrow batch of texts takes, on both sides, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives back to the system what ended work left to the allocators: a Python worker waits for its next task with what its largest one took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed ``most`` bytes; a longer single text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text).cast(pa.binary())), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
        del batch
    release()
