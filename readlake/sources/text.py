"""Text formats: accession tables, taxonomy dumps, SAM, FASTA, FASTQ.

Uncompressed text is read and split by Spark's own reader, blocked gzip is split by blocked.py; an ordinary gzip file is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions.sequences import flag_number
from readlake.operators.taxonomy import annotated
from readlake.schemas import ALIGNMENTS
from readlake.sources import blocked


def accession_table(spark: SparkSession, path: str, strict: bool = False, split: int = blocked.SPLIT) -> DataFrame:
    """(ord, accession, version, taxid) of an accession-to-taxon table; lines that break a rule go.

    Header and empty lines and lines that begin with a space go; the version is the accession, a dot and digits;
    the taxon is digits. A fourth column is allowed, unless strict. ord grows along each file.
    """
    lines = blocked.lines(spark, path, split).select("value", "ord")
    f = F.split("value", "\t")
    rows = lines.select("ord", "value", f.alias("f"), F.get(f, F.lit(0)).alias("accession"), F.get(f, F.lit(1)).alias("version"), F.get(f, F.lit(2)).alias("taxon"))
    ok = (F.col("value") != "") & ~F.col("value").startswith(" ") & (F.col("accession") != "accession") & F.col("accession").rlike(r"^\S{1,63}$")
    ok &= F.col("version").startswith(F.concat("accession", F.lit("."))) & F.substring("version", F.length("accession") + 2, F.length("version")).rlike("^[0-9]+$")
    ok &= F.col("taxon").rlike("^[0-9]+$") & (F.size("f") == 3 if strict else F.size("f") <= 4)
    return rows.where(F.coalesce(ok, F.lit(False))).select("ord", "accession", "version", F.col("taxon").try_cast("int").alias("taxid")).where("taxid is not null")


def _dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))


def taxonomy_dump(spark: SparkSession, folder: str, divisions: bool = False) -> DataFrame:
    """(taxid, parent, rank, name, division, genetic_code, mito_code, family, grp) of nodes.dmp and names.dmp.

    The name is the scientific one, in its unique form where it has one. divisions: names of division.dmp
    in the place of numbers. The files may be in any order.
    """
    f = F.col("f")
    nodes = _dump(spark, f"{folder}/nodes.dmp").select(f[0].try_cast("int").alias("taxid"), f[1].try_cast("int").alias("parent"), f[2].alias("rank"), f[4].alias("division"), f[6].try_cast("int").alias("genetic_code"), f[8].try_cast("int").alias("mito_code")).where("taxid is not null")
    names = _dump(spark, f"{folder}/names.dmp").where(f[3] == "scientific name").select(f[0].try_cast("int").alias("taxid"), F.when(f[2] != "", f[2]).otherwise(f[1]).alias("name"))
    out = nodes.join(names.groupBy("taxid").agg(F.min("name").alias("name")), "taxid", "left")
    if divisions:
        told = _dump(spark, f"{folder}/division.dmp").select(f[0].alias("division"), f[2].alias("division_name"))
        out = out.join(told, "division", "left").withColumn("division", F.col("division_name")).drop("division_name")
    return annotated(out.select("taxid", "parent", "rank", "name", "division", "genetic_code", "mito_code"))


def header_tags(lines: DataFrame) -> DataFrame:
    """(file, ord, kind, tags) of header lines (file, ord, value); a comment is the tag `text`; other lines go."""
    lines = lines.where(F.col("value").rlike("^@(HD|SQ|RG|PG|CO)(\t|$)"))
    pairs = F.transform(F.slice(F.split("value", "\t"), F.lit(2), F.size(F.split("value", "\t"))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(4), F.length(x)).alias("v")))
    kind = F.substring("value", 1, 3)
    tags = F.when(kind == "@CO", F.create_map(F.lit("text"), F.substring("value", F.lit(5), F.length("value")))).otherwise(F.map_from_entries(pairs))
    return lines.select("file", "ord", kind.alias("kind"), tags.alias("tags"))


def sam_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, tags) of the header lines of SAM text; of a folder that holds a header as a file of its own, that file alone is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/header*")
    own = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if own:
        return header_tags(spark.read.text([str(x.getPath()) for x in own]).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), "value"))
    return header_tags(blocked.lines(spark, path))


def query_length(cigar: Column) -> Column:
    """Letters of the read that a CIGAR string speaks of."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIS=X]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + F.coalesce(r.try_cast("bigint"), F.lit(0)))


def sam(spark: SparkSession, path: str, split: int = blocked.SPLIT) -> DataFrame:
    """Alignments of SAM text, with what the format leaves open put right.

    A reference that the headers don't name is none; without reference, place or CIGAR a read is unmapped (flag 4).
    A CIGAR of another length than the sequence is dropped with its place. Tags stay as text; CG takes the CIGAR's place.
    Flags may be decimal, hexadecimal or octal; a field that should be a number and is none is null, as 0 for a flag.
    """
    lines = blocked.lines(spark, path, split)
    known = sam_headers(spark, path).where("kind = '@SQ'").select(F.col("tags")["SN"].alias("sn")).distinct()
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select("file", "ord", f.alias("f")).where(F.size("f") >= 11)
    aux = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v"))))
    star = lambda i: F.when(F.get("f", F.lit(i)) != "*", F.get("f", F.lit(i)))
    cols = rows.select(
        F.get("f", F.lit(0)).alias("qname"), F.coalesce(flag_number(F.get("f", F.lit(1))), F.lit(0)).alias("flag"), star(2).alias("rname"), F.get("f", F.lit(3)).try_cast("long").alias("pos"), F.get("f", F.lit(4)).try_cast("int").alias("mapq"),
        star(5).alias("cigar"), star(6).alias("rnext"), F.get("f", F.lit(7)).try_cast("long").alias("pnext"), F.get("f", F.lit(8)).try_cast("int").alias("tlen"), star(9).alias("seq"), star(10).alias("qual"), aux.alias("aux"), "file", "ord",
    )
    cols = cols.withColumn("cigar", F.coalesce(F.regexp_replace(F.col("aux")["CG"], "^I,", ""), "cigar"))
    cols = cols.join(known, F.col("rname") == F.col("sn"), "left").withColumn("rname", F.col("sn")).drop("sn")
    fits = F.col("seq").isNull() | (query_length(F.col("cigar")) == F.length("seq"))
    mapped = F.coalesce(F.col("rname").isNotNull() & (F.col("pos") > 0) & F.col("cigar").isNotNull() & fits, F.lit(False))
    cols = cols.withColumn("flag", F.when(mapped, F.col("flag")).otherwise(F.col("flag").bitwiseOR(4))).withColumn("cigar", F.when(mapped, F.col("cigar"))).withColumn("rname", F.when(F.col("pos") > 0, F.col("rname")))
    cols = cols.withColumn("score", F.col("aux")["AS"].try_cast("int")).withColumn("md", F.col("aux")["MD"])
    return cols.select(*(c.split()[0] for c in ALIGNMENTS.replace("map<string,string>", "map").split(", ")))


def tag(aux: Column, name: str, kind: str) -> Column:
    """A tag's value by its format: i as long, f as double, B as an array of doubles, A, Z and H as text; null where it isn't of the format."""
    value = aux[name]
    if kind == "i":
        return value.try_cast("long")
    if kind == "f":
        return value.try_cast("double")
    if kind == "B":
        return F.when(value.rlike("^[cCsSiIf],"), F.transform(F.split(F.regexp_replace(value, "^[cCsSiIf],", ""), ","), lambda x: x.try_cast("double")))
    if kind == "A":
        return F.when(F.length(value) == 1, value)
    return F.when(value.rlike("^([0-9A-Fa-f]{2})*$"), value) if kind == "H" else value


#: Where a record stands: its file, and two numbers that grow along it.
PLACE = ("file", "at", "beside")


def fasta(spark: SparkSession, path: str, split: int = blocked.SPLIT, placed: bool = False) -> DataFrame:
    """(id, description, seq, qual) of FASTA: white space and signs other than letters and `-` go, case stays. placed: PLACE too."""
    parts = blocked.pieces(spark, path, "\n>", split).select(F.regexp_replace("value", "^>", "").alias("value"), "file", F.col("block").alias("at"), F.col("i").alias("beside")).where("trim(value) <> ''")
    head, body = F.regexp_extract("value", "^([^\n]*)", 1), F.regexp_replace("value", "^[^\n]*", "")
    text = F.regexp_extract(head, r"^\S*\s+(.*\S)\s*$", 1)
    return parts.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.when(text != "", text).alias("description"), F.regexp_replace(body, "[^A-Za-z-]", "").alias("seq"), F.lit(None).cast("string").alias("qual"), *(PLACE if placed else ()))


def fastq(spark: SparkSession, path: str, split: int = blocked.SPLIT, placed: bool = False) -> DataFrame:
    """(id, description, seq, qual) of FASTQ of four lines each; a record that breaks the format is an error. placed: PLACE too.

    Files are cut at lines that begin with `@`. A piece with a `+` line two below begins a record; any other
    is part of the quality, which may begin with `@` too, of the record before it, perhaps in the block of the
    file before. Pieces are numbered within blocks, and blocks by how many records begin in them.
    """
    pieces = blocked.pieces(spark, path, "\n@", split)
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    begins = (F.size(lines) >= 3) & F.get(lines, F.lit(2)).startswith("+")
    in_block = W.partitionBy("file", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    counted = pieces.withColumn("begins", begins.cast("int")).withColumn("k", F.sum("begins").over(in_block))
    before = counted.groupBy("file", "block").agg(F.sum("begins").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    records = counted.join(before.select("file", "block", F.coalesce("before", F.lit(0)).alias("before")), ["file", "block"]).withColumn("record", F.col("before") + F.col("k"))
    whole = records.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "i", "value"))), lambda x: x["value"]), "\n@").alias("value"))
    text = F.regexp_replace(F.when(F.col("record") == 1, F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value")), "\n$", "")
    f = F.split(text, "\n")
    ok = (F.size(f) == 4) & (F.length(F.get(f, F.lit(1))) == F.length(F.get(f, F.lit(3))))
    checked = whole.where(text != "").select(F.when(ok, f).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.substring("value", 1, 80)))).alias("f"), "file", F.col("record").alias("at"), F.lit(0).alias("beside"))
    told = F.regexp_extract(F.get("f", F.lit(0)), r"^\S*\s+(.*\S)\s*$", 1)
    return checked.select(F.regexp_extract(F.get("f", F.lit(0)), r"^(\S*)", 1).alias("id"), F.when(told != "", told).alias("description"), F.get("f", F.lit(1)).alias("seq"), F.get("f", F.lit(3)).alias("qual"), *(PLACE if placed else ()))


def kind_of(first: str) -> str:
    """The format that a file's first characters tell: fasta, fastq, packed, one, sam, or bam."""
    if first.startswith(("@HD\t", "@SQ\t", "@RG\t", "@PG\t", "@CO\t")):
        return "sam"
    return {">": "fasta", "@": "fastq", "b": "packed", "1": "one"}.get(first[:1], "bam")
