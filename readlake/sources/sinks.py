"""Writing tables as SAM, FASTA, FASTQ and reports, and names of outputs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators import sorting
from readlake.operators.reads import statistics
from readlake.sources import bucketed


def sam_lines(alignments: DataFrame) -> DataFrame:
    """One column `value`: each alignment as a SAM line; nulls are `*` or 0."""
    def text(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("*"))

    def num(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("0"))

    known = F.create_map(*(F.lit(x) for pair in {"AS": "i", "NM": "i", "NH": "i", "XN": "i", "XM": "i", "XO": "i", "XG": "i", "YS": "i"}.items() for x in pair))
    aux = F.array_join(F.transform(F.array_sort(F.map_entries("aux")), lambda e: F.concat_ws(":", e["key"], F.coalesce(known[e["key"]], F.lit("Z")), e["value"])), "\t")
    fields = [text("qname"), num("flag"), text("rname"), num("pos"), num("mapq"), text("cigar"), text("rnext"), num("pnext"), num("tlen"), text("seq"), text("qual")]
    return alignments.select(F.concat_ws("\t", *fields, F.nullif(F.coalesce(aux, F.lit("")), F.lit(""))).alias("value"))


def header_lines(headers: DataFrame) -> DataFrame:
    """One column `value`: header lines with VN, SN, ID first and the other tags in order of name."""
    pairs = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.struct((~e["key"].isin("VN", "SN", "ID")).alias("later"), e["key"].alias("k"), e["value"].alias("v"))))
    told = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["k"], p["v"])), "\t")
    return headers.select(F.concat_ws("\t", "kind", F.when(F.col("kind") == "@CO", F.col("tags")["text"]).otherwise(told)).alias("value"))


def sam(lines: DataFrame, header: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of SAM text: the header in a file of its own, whose name stands before those of the parts; then parts of lines.

    lines and header have one column `value`. Together in order of name they are one SAM file; text.sam reads the folder.
    """
    spark = lines.sparkSession
    lines.write.text(path, compression=compression)
    header.coalesce(1).write.text(path + "/_head", compression=compression)
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_head")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
    end = part.getName()[part.getName().index(".txt") :]
    if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header{end}")):
        raise OSError(f"can't name the header of {path}")
    fs.delete(at, True)


def named(sequences: DataFrame, *order: str) -> DataFrame:
    """sequences, those without an id under their number from 1 on in the order of columns, which go; without any, as the rows lie."""
    if sequences.where("id is null or id = ''").isEmpty():
        return sequences.drop(*order)
    rows = sorting.with_row_ids(sequences, *order, row_id="_n") if order else sorting.numbered(sequences, "_n")
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), (F.col("_n") + 1).cast("string"))).drop("_n", *order)


def fasta_lines(sequences: DataFrame) -> DataFrame:
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("id")), F.nullif("description", F.lit("")))
    return sequences.select(F.concat_ws("\n", head, "seq").alias("value"))


def fastq_lines(sequences: DataFrame) -> DataFrame:
    """A missing quality is `!` for every letter."""
    head = F.concat_ws(" ", F.concat(F.lit("@"), F.col("id")), F.nullif("description", F.lit("")))
    return sequences.select(F.concat_ws("\n", head, "seq", F.lit("+"), F.coalesce("qual", F.repeat(F.lit("!"), F.length("seq")))).alias("value"))


def report(df: DataFrame, path: str) -> None:
    """A report of one row for each taxon as one table with tabs; the largest taxa come first."""
    told = df.select(
        F.col("tax_id").alias("#tax_id"), "tax_name", "tax_rank", "count", F.format_string("%.1f", "av_len").alias("av_len"), F.format_string("%.1f", F.coalesce("av_score", F.lit(0.0))).alias("av_score"), F.format_string("%.2f", "av_dust").alias("av_dust"),
        F.format_string("%.3f", F.coalesce("av_gc", F.lit(0.0))).alias("av_GC"), F.format_string("%.2f %d/%d", "c_to_t", "n_c1_t", "n_c1").alias("5'CtoT"), F.col("hscore").alias("Hscore"), "family",
    )
    # as text, since the CSV writer puts quotes around a name that begins with a sign for comments
    head = df.sparkSession.createDataFrame([("\t".join(told.columns),)], "value string").select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("tax"), "value")
    lines = told.select(F.lit(1).alias("k"), "count", F.col("#tax_id").cast("int").alias("tax"), F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in told.columns)).alias("value"))
    head.unionByName(lines).orderBy("k", F.desc("count"), "tax").select("value").coalesce(1).write.text(path)


def rewritten(df: DataFrame, path: str, command: str | None = None, *sources: str) -> None:
    """Replaces the table at path by df, which may read it: written beside it first, then renamed into its place.

    With a command the table is written() with its history, else what stands beside the old table goes on standing beside the new one.
    The old table is put aside as path + ".old" before, and deleted last: whenever this is broken off, one of the two is whole.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    fs.delete(new, True)
    if command is not None:
        written(df, path + ".new", command, *sources)
    else:
        df.write.mode("overwrite").parquet(path + ".new")
        beside = jvm.org.apache.hadoop.fs.Path(path + "/_about")
        if fs.exists(beside):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, beside, fs, jvm.org.apache.hadoop.fs.Path(path + ".new/_about"), False, conf)
    fs.delete(old, True)
    for a, b in ((at, old), (new, at)):
        if not fs.rename(a, b):
            raise OSError(f"can't rename {a.toString()} to {b.toString()}")
    fs.delete(old, True)


def written(rows: DataFrame, path: str, command: str, *sources: str, buckets: int = 0, dealt: bool = False) -> None:
    """A table of reads with what it comes from beside it, in a folder that readers pass over: the history of its sources,
    this command and its date, and the table's statistics, which stored() gives back.

    Rows are numbered as they are written, and which file holds which numbers stands beside them too, for bucketed.slices().
    With buckets they are dealt and sorted by name, so that tables are merged without a shuffle; dealt: they lie so already.
    """
    rows = rows.drop(bucketed.PLACE)
    if buckets:
        bucketed.write(rows, path, buckets, dealt=dealt)
    else:
        rows.withColumn(bucketed.PLACE, F.monotonically_increasing_id()).write.parquet(path)
    bucketed.index(rows.sparkSession, path)
    noted(rows.sparkSession, path, command, *sources)


def noted(spark: SparkSession, path: str, command: str, *sources: str) -> None:
    """Writes the history of a table that stands at path, and its statistics, beside it."""
    history = [x for s in sources for x in about(spark, s)["history"]]
    now = spark.sql("select cast(now() as string)").first()[0]
    told = {"history": [*history, {"program": "readlake", "command": command, "sources": [*sources], "date": now}], "statistics": statistics(bucketed.plain(spark, path)).first().asDict()}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/_about")


def restated(spark: SparkSession, path: str) -> None:
    """Stores the statistics of a table as it stands beside it; its history stays."""
    told = {"history": about(spark, path)["history"], "statistics": statistics(bucketed.plain(spark, path)).first().asDict()}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/_about")


def about(spark: SparkSession, path: str) -> dict:
    """history and statistics of a table, as written() has stored them; empty ones of a table that has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_about")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {"history": [], "statistics": {}}
    return json.loads("".join(r[0] for r in spark.read.text(path + "/_about").collect()))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored statistics of a table as one row; without any a row without columns that anyone asks for."""
    told = about(spark, path)["statistics"] or {"nothing": None}
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


def derived(path: str, tag: str) -> str:
    """The name of an output: that of the input without .gz and its last extension, and the tag."""
    stem = re.sub(r"\.gz$", "", path)
    return re.sub(r"\.[^./]*$", "", stem) + "." + tag
