"""A session with the settings that the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a union of tables bucketed by the grouping key otherwise groups each by itself
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "readlake", **settings: str) -> SparkSession:
    """A session, local or on the cluster that spark-submit names; settings are added to SETTINGS."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    A temporary folder serves a local session that names none, as in tests; on a cluster, whose machines share no such
    folder, that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="readlake-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for what is written and read again."""
    return f"{shared_folder(spark)}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df behind a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a few numbers each up to which a table may be sent to every task.
MOST_SENT = 1_000_000


def sized(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked to be sent to every task if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows that a task writes into a part of its own.
PART = 500_000


def parts(df: DataFrame, least: int, each: int = PART) -> int:
    """Into how many parts to write df, so that a part stays as large as it is however many rows there are."""
    return max(least, -(-df.count() // each))
