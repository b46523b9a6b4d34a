"""The text form of the typed-line container: reads and interval tables as lines of one letter and fields.

Objects begin with their own letter, so files are cut at such lines and need no index; strings are
written as length and text. Binary containers are converted to text by their own tools.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.functions import flat
from readlake.functions.sequences import plain_and_odd
from readlake.schemas import TAX


def _after_length(text: Column) -> Column:
    """The string of `length text`."""
    n = F.regexp_extract(text, "^([0-9]+) ", 1)
    return F.substring(text, F.length(n) + 2, n.try_cast("int"))


def _is_head() -> Column:
    """Whether a piece is what stands before the first object of a file, by its first line."""
    return F.col("value").rlike("^1 [0-9]+ [a-z]+ [0-9]+ [0-9]+")


def _pieces(spark: SparkSession, path: str, letter: str) -> DataFrame:
    """(value, file, block): files cut at the lines of a letter."""
    return spark.read.option("lineSep", f"\n{letter} ").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _objects(spark: SparkSession, path: str, letter: str) -> DataFrame:
    """(lines, head): each object's lines, its own without the letter; head is what stands before the first object of a file."""
    return _pieces(spark, path, letter).select("file", "block", F.monotonically_increasing_id().alias("i"), _is_head().alias("is_head"), F.split("value", "\n").alias("lines"))


#: Bytes of lines that are taken apart at once.
PARSED = 4 << 20


def _parted(text: str) -> tuple[str | None, str]:
    """A read's sequence with the exceptions of its N lines put back, and its other lines; no sequence if a line lacks its numbers."""
    own, *lines = text.split("\n")
    n, space, seq = own.partition(" ")
    found = [x[2:].split(" ") for x in lines if x.startswith("N ")]
    whole = space and all(len(f) > 2 and f[0].isdecimal() and f[2].isdecimal() for f in found) and n.isascii() and n.isdecimal()
    told = flat.put_back(seq[: int(n)], ((int(f[0]), f[1], int(f[2])) for f in found)) if whole else None
    return told, "\n".join(x for x in lines if not x.startswith("N ")) if found else "\n".join(lines)


def _laid(text: pa.Array) -> pa.Array:
    """_parted() of many reads, lines that tell no plain (pos, base, run) read by read."""
    lines = pc.split_pattern(text, "\n")
    every, offsets = lines.flatten(), lines.offsets.to_numpy()
    row, own = np.repeat(np.arange(len(text)), np.diff(offsets)), np.zeros(len(every), bool)
    own[offsets[:-1]] = True
    odd = pc.starts_with(every, "N ").to_numpy(zero_copy_only=False) & ~own
    told, kept = every.filter(pa.array(odd)), ~(odd | own)
    fields = pc.split_pattern(told, " ")
    plain = pc.all(pc.match_substring_regex(told, "^N [0-9]{1,9} [^ ]+ [0-9]{1,9}$")).as_py() is not False
    if not plain:
        some = [_parted(x) for x in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in some], pa.string()) for i in range(2)], ["seq", "rest"])
    pos, base, run = (fields.flatten().take(pa.array(np.arange(i, 4 * len(told), 4))) for i in (1, 2, 3))
    runs = pa.StructArray.from_arrays([pos.cast(pa.int32()), base, run.cast(pa.int32())], ["pos", "base", "run"])
    none = np.zeros(len(text), bool)
    seq = pa.array([_parted(x)[0] for x in every.filter(pa.array(own)).to_pylist()], pa.string())
    rest = pc.binary_join(flat.listed(every.filter(pa.array(kept)), np.bincount(row[kept], minlength=len(text)), none), "\n")
    return pa.StructArray.from_arrays([flat.overlaid(seq, flat.listed(runs, np.bincount(row[odd], minlength=len(text)), none)), rest], ["seq", "rest"])


@F.arrow_udf(T.StructType().add("seq", "string").add("rest", "string"))
def _read_parts(value: pa.Array) -> pa.Array:
    """A read's sequence with its exceptions put back, and its lines other than these."""
    return flat.in_stretches(_laid, PARSED, value)


def reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads (schemas.READS) of read files in text form; lines of other letters are passed over, absent ones are null."""
    rows = _pieces(spark, path, "S")
    prefixes = rows.where(_is_head()).select("file", F.explode(F.split("value", "\n")).alias("l")).where("l like 'P %'").select("file", _after_length(F.substring("l", F.lit(3), F.length("l"))).alias("prefix"))
    objects = rows.where(~_is_head()).join(F.broadcast(prefixes), "file", "left").select("prefix", _read_parts("value").alias("x")).select("prefix", "x.seq", F.split("x.rest", "\n").alias("lines"))

    def of(letter: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x.startswith(letter + " ")), lambda x: F.substring(x, F.lit(3), F.length(x)))

    def one(letter: str) -> Column:
        return F.get(of(letter), F.lit(0))

    tax = F.transform(of("T"), lambda x: F.struct(F.split(x, " ")[0].try_cast("int").alias("taxid"), F.split(x, " ")[1].try_cast("int").alias("best_score"), F.split(x, " ")[2].try_cast("bigint").alias("cnt")))
    return objects.select(
        F.concat(F.coalesce("prefix", F.lit("")), _after_length(one("I"))).alias("name"), "seq", _after_length(one("Q")).alias("qual"),
        F.split(one("M"), " ")[0].try_cast("int").alias("max_score"), _after_length(F.regexp_replace(one("M"), "^-?[0-9]+ ", "")).alias("mline"), one("D").try_cast("int").alias("dust"), one("L").try_cast("int").alias("lca"), tax.cast(TAX).alias("tax"),
    )


def read_lines(rows: DataFrame) -> DataFrame:
    """One column `value`: each read's lines; bases other than a, c, g, t stand as `a` and as lines of their own."""
    def text(c: Column) -> Column:
        return F.concat_ws(" ", F.length(c).cast("string"), c)

    def line(letter: str, told: Column) -> Column:
        return F.concat(F.lit(letter + " "), told)

    taxa = F.transform(F.coalesce("tax", F.array().cast(TAX)), lambda t: F.concat_ws(" ", F.lit("T"), t["taxid"].cast("string"), t["best_score"].cast("string"), t["cnt"].cast("string")))
    match = F.when(F.col("mline").isNotNull(), line("M", F.concat_ws(" ", F.coalesce("max_score", F.lit(0)).cast("string"), text(F.col("mline")))))
    one = F.array_compact(F.array(line("S", text(F.col("_s.plain"))), line("I", text(F.col("name"))), line("Q", text(F.col("qual"))), line("D", F.col("dust").cast("string")), line("L", F.col("lca").cast("string")), match, F.nullif(F.col("_s.odd"), F.lit(""))))
    return rows.select("*", plain_and_odd("seq").alias("_s")).select(F.when(F.col("seq").isNotNull(), F.array_join(F.concat(one, taxa), "\n")).alias("value"))


def bytes_by_letter(rows: DataFrame) -> DataFrame:
    """(letter, lines, bytes) of a table of reads in text form, a line's end included."""
    lines = read_lines(rows).select(F.explode(F.split("value", "\n")).alias("l"))
    return lines.groupBy(F.substring("l", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("l") + 1).alias("bytes"))


#: The first lines of files of reads and of interval tables.
HEAD, INTERVAL_HEAD = "1 3 seq 2 1\n2 4 read", "1 6 acctax 2 1"


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """lines with the head before the first one of each partition."""
    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=b.schema)
                first = False
            yield b

    return lines.mapInArrow(headed, "value string")


def write_reads(rows: DataFrame, path: str) -> None:
    """A folder of parts, each a whole read file in text form."""
    _headed(read_lines(rows), HEAD).write.text(path)


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, start, count, taxid) of an interval table in text form, whose prefixes are written as what is new in each.

    A prefix goes on from the one before it, so rows are read in order, by a fold that holds one prefix; a row that shares
    nothing with the one before begins a stretch, and stretches are read apart from each other.
    """
    from pyspark.sql import Window as W

    rows = _objects(spark, path, "A").where("not is_head").select("file", "block", "i", F.split(F.get("lines", F.lit(0)), " ").alias("f"))
    new = rows.select("file", "block", "i", F.get("f", F.lit(0)).try_cast("int").alias("taxid"), F.get("f", F.lit(1)).try_cast("bigint").alias("start"), F.get("f", F.lit(2)).try_cast("bigint").alias("count"), F.get("f", F.lit(3)).try_cast("int").alias("shared"), F.coalesce(F.get("f", F.lit(5)), F.lit("")).alias("suffix"))
    begins = ((F.col("suffix") != "") & (F.col("shared") == 0)).cast("int")
    counted = new.withColumn("k", F.sum(begins).over(W.partitionBy("file", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    before = new.groupBy("file", "block").agg(F.sum(begins).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = counted.join(before.select("file", "block", "before"), ["file", "block"]).withColumn("stretch", F.col("before") + F.col("k"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prefix = None, ""
        for b in batches:
            out = []
            for of, shared, suffix in zip(zip(b.column("file").to_pylist(), b.column("stretch").to_pylist(), strict=True), b.column("shared").to_pylist(), b.column("suffix").to_pylist(), strict=True):
                if of != now:
                    now, prefix = of, ""
                if suffix:
                    prefix = prefix[: shared or 0] + suffix
                out.append(prefix)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(b.column(c) for c in ("start", "count", "taxid"))], ["prefix", "start", "count", "taxid"])

    dealt = placed.repartition("file", "stretch").sortWithinPartitions("file", "stretch", "block", "i")
    return dealt.mapInArrow(fold, "prefix string, start long, count long, taxid int")


def interval_lines(rows: DataFrame) -> DataFrame:
    """One column `value`: each interval of a table (prefix, start, count, taxid) as a line with its whole prefix."""
    suffix = F.concat_ws(" ", F.length("prefix").cast("string"), "prefix")
    return rows.select(F.concat_ws(" ", F.lit("A"), F.col("taxid").cast("string"), F.col("start").cast("string"), F.col("count").cast("string"), F.lit("0"), suffix).alias("value"))


def write_intervals(rows: DataFrame, path: str) -> None:
    """A folder of parts, each a whole interval table in text form, in order of prefix and start."""
    _headed(interval_lines(rows.orderBy("prefix", "start")), INTERVAL_HEAD).write.text(path)
