"""Accession numbers: their parts, run-length intervals of equal taxa, and the join with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.schemas import need

#: Width of the pieces into which intervals are cut for the join.
PIECE = 1 << 16


def prefix(accession: Column) -> Column:
    """The accession without version and without its last digits."""
    return F.regexp_extract(accession, r"^(.*?)([0-9]*)(\.[0-9]+)?$", 1)


def number(accession: Column) -> Column:
    """Its last digits before the version as a number, 0 without any; leading zeros are lost."""
    return F.coalesce(F.regexp_extract(accession, r"^(.*?)([0-9]*)(\.[0-9]+)?$", 2).try_cast("bigint"), F.lit(0).cast("bigint"))


def parsed(df: DataFrame, column: str = "accession") -> DataFrame:
    return df.withColumn("prefix", prefix(F.col(column))).withColumn("n", number(F.col(column)))


def intervals_in_file_order(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(prefix, start, count, taxid): consecutive rows (ord) of a prefix with one taxid and numbers that go up by 1.

    Islands are found within pieces of ord first, so a prefix that holds most rows is spread; of a piece's islands only the
    first and the last can go on in another piece, so the second window sees two rows of a prefix and piece.
    """
    need(rows, "ord", "accession", "taxid")
    marked = parsed(rows).withColumn("piece", F.floor(F.col("ord") / piece))
    order = W.partitionBy("prefix", "piece").orderBy("ord")
    goes_on = (F.lag("taxid").over(order) == F.col("taxid")) & (F.lag("n").over(order) + 1 == F.col("n"))
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    found = marked.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", island).groupBy("prefix", "piece", "island").agg(F.min("n").alias("start"), F.count(F.lit(1)).alias("count"), F.first("taxid").alias("taxid"))
    ends = found.withColumn("end", (F.col("island") == 1) | (F.col("island") == F.max("island").over(W.partitionBy("prefix", "piece"))))
    order = W.partitionBy("prefix").orderBy("piece", "island")
    on = (F.lag("taxid").over(order) == F.col("taxid")) & (F.lag(F.col("start") + F.col("count")).over(order) == F.col("start")) & (F.lag("piece").over(order) != F.col("piece"))
    whole = ends.where("end").withColumn("new", F.when(on, 0).otherwise(1)).withColumn("whole", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = whole.groupBy("prefix", "taxid", "whole").agg(F.min("start").alias("start"), F.sum("count").alias("count"))
    columns = ["prefix", "start", "count", "taxid"]
    return ends.where("not end").select(*columns).unionByName(joined.select(*columns))


def intervals(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(prefix, start, count, taxid) whatever the order of the rows (accession, taxid).

    Equal rows count once; where an accession has several taxa each makes its own intervals. Islands
    are found within pieces of the numbers first, so a prefix that holds most rows is spread; of them only such
    as touch the end of their piece can go on in another, so the second window sees two rows of a piece at most.
    """
    need(rows, "accession", "taxid")
    one = parsed(rows).select("prefix", "n", "taxid").distinct().withColumn("piece", F.floor(F.col("n") / piece))
    order = W.partitionBy("prefix", "taxid", "piece").orderBy("n")
    islands = one.withColumn("island", F.col("n") - F.row_number().over(order)).groupBy("prefix", "taxid", "piece", "island").agg(F.min("n").alias("start"), F.count(F.lit(1)).alias("count"))
    touches = (F.col("start") % piece == 0) | ((F.col("start") + F.col("count")) % piece == 0)
    order = W.partitionBy("prefix", "taxid").orderBy("start")
    new = F.when(F.lag(F.col("start") + F.col("count")).over(order) == F.col("start"), 0).otherwise(1)
    whole = islands.where(touches).withColumn("new", new).withColumn("whole", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = whole.groupBy("prefix", "taxid", "whole").agg(F.min("start").alias("start"), F.sum("count").alias("count"))
    columns = ["prefix", "start", "count", "taxid"]
    return islands.where(~touches).select(*columns).unionByName(joined.select(*columns))


def with_taxa(refs: DataFrame, acctax: DataFrame, column: str = "accession", piece: int = PIECE) -> DataFrame:
    """refs with taxid: that of the first interval (by start, then taxid) that holds the accession; 0 without one.

    Intervals are cut at multiples of piece, so prefix and piece number make an equi-join whatever share of
    the accessions one prefix has.
    """
    need(acctax, "prefix", "start", "count", "taxid")
    cut = acctax.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("start") + F.col("count") - 1) / piece))))
    keys = parsed(refs.select(F.col(column).alias("accession")).distinct()).withColumn("piece", F.floor(F.col("n") / piece))
    found = keys.join(cut, ["prefix", "piece"]).where("n >= start and n < start + count").groupBy("accession").agg(F.min(F.struct("start", cut["taxid"].alias("taxid"))).alias("first"))
    out = refs.join(found.select(F.col("accession").alias("_found"), F.col("first.taxid").alias("taxid")), F.col(column) == F.col("_found"), "left")
    return out.drop("_found").withColumn("taxid", F.coalesce("taxid", F.lit(0)))
