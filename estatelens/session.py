"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was measured and found below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024

# AQE splits hot join keys; the force flag keeps it doing so when an aggregate follows the join.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "estatelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoints go once nothing refers to them.
    for key, value in {**SQL_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temp folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="estatelens-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by ``keys``: a table read by one or two tasks may hold texts whose reading takes all of them.

    Write the rows before they are filtered by what is read in them: Spark moves such a filter in front of the dealing.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`checkpoint`, in columns and read back: for loops whose rounds join what earlier rounds left.

    A checkpoint keeps the size estimated for its plan, and a join's is the product of its sides', so in such a loop its digits multiply by each round
    until the driver's memory is full of them.  What is read back has the size of its files.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what :func:`written` left and nothing still to be computed reads."""
    for df in written:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size, for the broadcast check."""
    widths = []
    for field in df.schema.fields:
        if field.dataType.simpleString() == "string":
            widths.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 24)
        else:
            widths.append(F.lit(24))
    total = F.lit(16)
    for width in widths:
        total = total + width
    return total.cast("long")


def broadcast_if_small(df: DataFrame, size_bytes: int) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave the join to AQE's shuffle plan."""
    return F.broadcast(df) if size_bytes <= BROADCAST_BYTES else df
