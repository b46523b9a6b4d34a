"""Taxa of reads kept up to date while alignments arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readlake.operators.reads import taxa_of
from readlake.session import parts

#: Buckets of a folded table, and batches after which new ones are folded into it.
BUCKETS, EVERY = 16, 8


def running_taxa(alignments: DataFrame, key: str = "qname") -> DataFrame:
    """(key, taxid, best_score, cnt) over all that a stream has brought; write it in update mode.

    Counts add up and scores take the maximum, so each micro-batch needs only the state of the reads in it. The state
    holds a row for every read and taxon for good: for streams without an end take windowed_taxa or ingest.
    """
    return taxa_of(alignments, key)


def windowed_taxa(alignments: DataFrame, time: str, size: str, late: str, key: str = "qname") -> DataFrame:
    """(start, key, taxid, best_score, cnt) of the alignments of each stretch of time; write it in append mode.

    A stretch is given out, and its state let go, when the stream has come `late` past its end; what comes later still is left out.
    """
    rows = alignments.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key, "taxid")
    return rows.agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), key, "taxid", "best_score", "cnt")


def ingest(alignments: DataFrame, path: str, checkpoint: str, key: str = "qname", every: int = EVERY, buckets: int = BUCKETS) -> StreamingQuery:
    """Writes the taxa of each micro-batch beside each other under path, holds no state, and folds batches into buckets every so often.

    A batch that is done again after a failure replaces what it has written, or does nothing if it is folded already. Ends when
    all that is there has been read.
    """
    def put(rows: DataFrame, i: int) -> None:
        if i <= folded(rows.sparkSession, path)["upto"]:
            return
        taxa_of(rows, key).write.mode("overwrite").parquet(f"{path}/batch={i}")
        if every and (i + 1) % every == 0:
            fold(rows.sparkSession, path, i, key, buckets)

    return alignments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def folded(spark: SparkSession, path: str) -> dict:
    """upto: the last batch that is folded, -1 if none; at: which fold holds each bucket now; buckets: how many there are."""
    some = [int(x) for x in _names(spark, f"{path}/_folds") if x.isdigit()]
    if not some:
        return {"upto": -1, "at": {}, "buckets": 0}
    return json.loads(spark.read.text(f"{path}/_folds/{max(some)}").first()[0])


def _unfolded(spark: SparkSession, path: str, after: int) -> list[str]:
    return [f"{path}/{x}" for x in _names(spark, path) if x.startswith("batch=") and int(x[6:]) > after]


def _summed(rows: DataFrame, key: str, *more: str) -> DataFrame:
    return rows.groupBy(*more, key, "taxid").agg(F.max("best_score").alias("best_score"), F.sum("cnt").alias("cnt"))


def fold(spark: SparkSession, path: str, upto: int, key: str = "qname", buckets: int = BUCKETS) -> None:
    """Folds the batches up to one into hash buckets of the key; only buckets that they touch are written anew, each as one file, or as several if it has grown large.

    A fold writes its buckets beside the old ones and then its list of all buckets under the number of its last batch: with that the
    fold counts, once. What is broken off before counts for nothing and is written over by the next try. Batches and buckets that
    the fold has replaced go afterwards.
    """
    now = folded(spark, path)
    n = now["buckets"] or buckets
    new = [p for p in _unfolded(spark, path, now["upto"]) if int(p.rsplit("=", 1)[1]) <= upto]
    if not new:
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = spark.read.parquet(*new).withColumn("bucket", bucket)
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
    old = [f"{path}/_fold={now['at'][str(b)]}/bucket={b}" for b in touched if str(b) in now["at"]]
    if old:
        rows = rows.unionByName(spark.read.parquet(*old).withColumn("bucket", bucket))
    many = parts(rows, n)  # more than one file of a bucket, where it holds too many rows for one task
    piece = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(-(-many // n)))
    _summed(rows, key, "bucket").repartition(many, "bucket", piece).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_fold={upto}")
    told = {"upto": upto, "buckets": n, "at": now["at"] | {str(b): upto for b in touched}}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_folds/_{upto}")
    at, fs = _fs(spark, f"{path}/_folds/_{upto}")
    fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_folds/{upto}"))
    for gone in [*new, *old]:
        at, fs = _fs(spark, gone)
        fs.delete(at, True)


def current_taxa(spark: SparkSession, path: str, key: str = "qname") -> DataFrame:
    """(key, taxid, best_score, cnt) of all that ingest() has written so far; equal to the taxa of all alignments at once.

    The files of buckets, and the batches since the last fold, if there are any. No rows, with keys as text, if nothing has come yet.
    """
    now = folded(spark, path)
    new = _unfolded(spark, path, now["upto"])
    parts = [f"{path}/_fold={f}/bucket={b}" for b, f in now["at"].items()]
    if not new and not parts:
        return spark.createDataFrame([], f"`{key}` string, taxid int, best_score int, cnt long")
    if not new:
        return spark.read.parquet(*parts)
    return _summed(spark.read.parquet(*new, *parts), key)
