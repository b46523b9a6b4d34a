"""Tables of reads dealt into buckets by name when they are written, so that merging them shuffles nothing.

A bucketed table is a folder of Parquet files, one for each bucket, sorted by name, with the number of buckets beside
them in `_buckets`. Which bucket a file is, its name tells; that there are buckets, only a catalog can tell Spark. So reading
registers the folder as a table of the session's catalog; several tables become the partitions of one, whose scan brings the
same bucket of all of them to one task: names are grouped and joined where they lie.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table if no one says otherwise; tables are merged without a shuffle if they have as many as each other.
BUCKETS = 32
#: Numbers of rows in the order in which they are written: of each file from a first one on without a gap.
PLACE = "place"


def write(rows: DataFrame, path: str, n: int = BUCKETS, key: str = "name", dealt: bool = False) -> None:
    """Writes rows into n buckets by key. dealt: they lie in these buckets already, as what is made of merged() does; else one shuffle deals them."""
    spark = rows.sparkSession
    rows = (rows if dealt else rows.repartition(n, key)).sortWithinPartitions(key)
    name, rows = _name(), rows.withColumn(PLACE, F.monotonically_increasing_id())
    rows.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    told = {"buckets": n, "key": key, "schema": rows.schema.jsonValue()}  # without rows there is no file to tell the schema
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(path + "/_buckets")


def _told(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_buckets")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(path + "/_buckets").first()[0])


def buckets_of(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(buckets, key) of a table, or None of one without buckets."""
    told = _told(spark, path)
    return told and (told["buckets"], told["key"])


def plain(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as they stand, places included."""
    told = _told(spark, path)
    return spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(path) if told else spark.read.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table of reads; if it has buckets, grouping it by its key needs no shuffle."""
    told = buckets_of(spark, path)
    return plain(spark, path).drop(PLACE) if told is None else _table(spark, [path], told).drop("source", PLACE)


def together(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Rows of several tables with their number as source, dealt by key as they stand; None if not all have the same buckets and columns."""
    told = {buckets_of(spark, p) for p in paths}
    shapes = {tuple((f.name, f.dataType.simpleString()) for f in plain(spark, p).schema) for p in paths}
    if len(told) != 1 or None in told or len(shapes) != 1:
        return None
    return _table(spark, paths, told.pop()).drop(PLACE)


def _table(spark: SparkSession, paths: list[str], told: tuple[int, str]) -> DataFrame:
    n, key = told
    name, columns = _name(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain(spark, paths[0]).schema)
    first = paths[0].rstrip("/").replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}, source int) using parquet partitioned by (source) clustered by (`{key}`) sorted by (`{key}`) into {n} buckets location '{first}/_all'")
    for i, path in enumerate(paths):
        at = path.replace("'", "\\'")
        spark.sql(f"alter table {name} add partition (source={i}) location '{at}'")
    return spark.table(name)


def _name() -> str:
    return f"readlake_{uuid.uuid4().hex}"


def index(spark: SparkSession, path: str) -> None:
    """Writes beside a table with places which of them each file holds, and how many rows stand in the files before it by name."""
    from pyspark.sql import Window as W

    files = plain(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    files.withColumn("start", before).coalesce(1).write.mode("overwrite").parquet(path + "/_index")


def indexed(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_index")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def slices(spark: SparkSession, path: str, ranges: list[tuple[int, int | None]]) -> DataFrame:
    """Rows of an indexed table with their numbers as row_id, those in [x, y) of a range; (x, None) is the row x alone.

    Numbers follow the order of files and of rows in them. Only files that hold such rows are opened, and in those at a range's ends
    only the row groups that do: places ascend in a file, so Parquet's statistics tell them.
    """
    spans = [(x, x + 1 if y is None else y) for x, y in ranges]
    files = spark.read.parquet(path + "/_index")
    hit = F.lit(False)
    for x, y in spans:
        hit = hit | ((F.col("start") < y) & (F.col("start") + F.col("n") > x))
    found = [(r.file, r.first, r.n, r.start) for r in files.where(hit).orderBy("file").collect()]  # files that the slices need anyway
    out = plain(spark, path).where("false").withColumn("row_id", F.lit(0).cast("long")) if not found else None
    whole = [f for f in found if any(x <= f[3] and f[3] + f[2] <= y for x, y in spans)]
    for some, ends in ((whole, False), ([f for f in found if f not in whole], True)):
        if some:
            rows = spark.read.parquet(*(f"{path}/{f[0]}" for f in some))
            if ends:
                keep = F.lit(False)
                for _, first, n, start in some:
                    for x, y in spans:
                        a, z = max(x, start), min(y, start + n)
                        if a < z:
                            keep = keep | F.col(PLACE).between(first + a - start, first + z - start - 1)
                rows = rows.where(keep)
            of = spark.createDataFrame([(f[0], f[3] - f[1]) for f in some], "_file string, _shift long")
            rows = rows.withColumn("_of", F.col("_metadata.file_name")).join(F.broadcast(of), F.col("_of") == F.col("_file")).withColumn("row_id", F.col(PLACE) + F.col("_shift")).drop("_of", "_file", "_shift")
            out = rows if out is None else out.unionByName(rows)
    return out.drop(PLACE)
