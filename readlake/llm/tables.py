"""Reading the tables and cutting lineage, for queries of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, a temporary one serves a local session, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="readlake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df behind a reliable checkpoint, which outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, n: int, *columns: str, in_order: bool = False) -> DataFrame:
    """The rows of df behind a checkpoint, dealt by columns, in_order also sorted by them: joins and groups by these don't shuffle or sort them again."""
    rows = df.repartition(n, *columns)
    return as_dealt(rows.sortWithinPartitions(*columns) if in_order else rows)


def as_dealt(df: DataFrame) -> DataFrame:
    """The rows of df behind a checkpoint that knows how its last exchange has dealt them.

    An adaptive plan forgets that when it is cut, so this one isn't adaptive.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a compressed table in the checkpoint folder: smaller than a checkpoint where rows are many."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() has written for df, once nothing reads it any more: what was made of it is cut or stored itself."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/rows-" in folder:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a few numbers each up to which a table may be sent to every task.
MOST_SENT = 200_000


def sized(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked to be sent to every task if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slots_of(spark: SparkSession) -> int:
    """Into how many slots signatures are dealt: fewer than partitions, as an owner's name goes into each slot that it has a signature in."""
    return max(8, -(-partitions(spark) // 4))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, as a text may be long; bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving freed memory back to the system from time to time and at its end: Python workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(f(batches)):
            yield b
            if i % 64 == 63:
                give_back()
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; its own rules hold
