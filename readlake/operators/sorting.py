"""Alignment files put in order of name, with one header for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.schemas import need
from readlake.session import cut


def by_name(*inputs: DataFrame, name: str = "qname", order: tuple[str, ...] = ("file", "ord")) -> DataFrame:
    """All rows in byte order of name, equal ones by order: ranges of names to partitions, sorted within."""
    rows = inputs[0]
    for more in inputs[1:]:
        rows = rows.unionByName(more)
    return rows.orderBy(name, *order)


def in_order(rows: DataFrame, name: str = "qname") -> DataFrame:
    """(partitions, disordered): whether each partition is sorted by name and begins where the one before it ends."""
    part = rows.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.col(name).alias("name"))
    within = part.withColumn("before", F.lag("name").over(W.partitionBy("p").orderBy("i"))).groupBy("p").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.sum((F.col("before") > F.col("name")).cast("long")).alias("bad"))
    across = within.withColumn("ahead", F.lead("low").over(W.orderBy("p")))
    return across.agg(F.count(F.lit(1)).alias("partitions"), F.sum(F.coalesce("bad", F.lit(0)) + F.coalesce((F.col("high") > F.col("ahead")).cast("long"), F.lit(0))).alias("disordered"))


def used_references(headers: DataFrame, alignments: DataFrame, mates: bool = True) -> DataFrame:
    """The @SQ lines whose sequence some alignment, or its mate, lies on; all lines of other kinds."""
    names = alignments.select(F.col("rname").alias("sn"))
    if mates:
        names = names.unionByName(alignments.select(F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("sn")))
    used = names.where("sn is not null and sn <> '*'").distinct()
    return headers.where("kind <> '@SQ'").unionByName(headers.where("kind = '@SQ'").join(used, F.col("tags")["SN"] == F.col("sn"), "left_semi"))


def program_id(file: Column, own: Column) -> Column:
    """A program's id among those of all files: its own and a digest of the file's name."""
    return F.concat(own, F.lit("-"), F.upper(F.substring(F.md5(F.concat_ws("\t", file, own)), 1, 8)))


def united(headers: DataFrame) -> DataFrame:
    """One header of several files' (file, ord, kind, tags): (file, ord, kind, tags), lines in order.

    Of @HD the first line stays, with its VN or 1.6, and says that names are in order; of @SQ the first for each SN,
    of @RG the first for each ID; @PG lines all stay under ids of their own, to which PP points, where the
    program it points to is there; @CO lines all stay. "First" is by file, then ord.
    """
    need(headers, "file", "ord", "kind", "tags")
    key = F.when(F.col("kind") == "@HD", "").when(F.col("kind") == "@SQ", F.col("tags")["SN"]).when(F.col("kind") == "@RG", F.col("tags")["ID"]).otherwise(F.concat_ws("\t", "file", F.col("ord").cast("string")))
    first = headers.groupBy("kind", key.alias("key")).agg(F.min_by(F.struct("file", "ord", "tags"), F.struct("file", "ord")).alias("x")).select("x.file", "x.ord", "kind", "x.tags")
    known = headers.where("kind = '@PG'").select(F.col("file").alias("f"), F.col("tags")["ID"].alias("pp")).distinct()
    rows = first.join(known, (F.col("file") == F.col("f")) & (F.col("tags")["PP"] == F.col("pp")) & (F.col("kind") == "@PG"), "left")

    def put(name: str, value: Column) -> Column:
        return F.map_concat(F.map_filter(F.col("tags"), lambda k, v: k != name), F.create_map(F.lit(name), value))

    head = F.map_from_arrays(F.array(F.lit("VN"), F.lit("SO")), F.array(F.coalesce(F.col("tags")["VN"], F.lit("1.6")), F.lit("queryname")))
    own = put("ID", program_id(F.col("file"), F.col("tags")["ID"]))
    linked = F.map_concat(F.map_filter(own, lambda k, v: k != "PP"), F.create_map(F.lit("PP"), program_id(F.col("file"), F.col("tags")["PP"])))
    tags = F.when(F.col("kind") == "@HD", head).when((F.col("kind") == "@PG") & F.col("pp").isNotNull(), linked).when(F.col("kind") == "@PG", own).otherwise(F.col("tags"))
    rank = F.array_position(F.array(*(F.lit(k) for k in ("@HD", "@SQ", "@RG", "@PG", "@CO"))), F.col("kind"))
    return rows.select("file", "ord", "kind", tags.alias("tags"), rank.alias("rank")).orderBy("rank", "file", "ord").drop("rank")


def with_row_ids(rows: DataFrame, *order: str, row_id: str = "row_id") -> DataFrame:
    """rows numbered from 0 on in the order of columns: sorted by ranges, numbered within, counts of ranges before added."""
    return numbered(rows.orderBy(*order), row_id)


def numbered(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """rows numbered from 0 on as they lie, partition after partition."""
    part = cut(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before = part.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_low")).withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(before.drop("n")), "_p").withColumn(row_id, F.col("_before") + F.col("_i") - F.col("_low")).drop("_p", "_i", "_low", "_before")


def slices(rows: DataFrame, ranges: list[tuple[int, int | None]], row_id: str = "row_id") -> DataFrame:
    """Rows whose number lies in [x, y) of a range; (x, None) is the row x alone."""
    keep = F.lit(False)
    for x, y in ranges:
        keep = keep | ((F.col(row_id) >= x) & (F.col(row_id) < (x + 1 if y is None else y)))
    return rows.where(keep)
