"""Commands over files, thin covers of the operators: python -m readlake.cli COMMAND ...

Tables are Parquet; names of outputs follow those of inputs unless -o gives one.
"""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import sequences as S
from readlake.operators import accessions, reads, reports, scaffolds, sorting, taxonomy
from readlake.schemas import TAX
from readlake.session import session
from readlake.sources import bam, blocked, bucketed, container, merging, one, packed, sinks, text


def alignments(spark: SparkSession, path: str) -> DataFrame:
    return bam.alignments(spark, path) if path.endswith(".bam") else text.sam(spark, path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    return bam.headers(spark, path) if path.endswith(".bam") else text.sam_headers(spark, path)


def sequences(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """(id, description, seq, qual) of FASTA, FASTQ, SAM, BAM, a container in text form or a table of reads, by name or first line.

    placed: with text.PLACE too where the format is FASTA or FASTQ, whose records may lack an id.
    """
    def flat(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias("id"), F.lit(None).cast("string").alias("description"), "seq", "qual")

    if path.endswith((".parquet", ".1read")):
        return flat(bucketed.read(spark, path), "name")
    kind = "bam" if path.endswith(".bam") else text.kind_of((spark.read.text(path).first() or [""])[0] + "\t")
    if kind in ("bam", "sam"):  # a row for each record, as it stands
        return flat(alignments(spark, path), "qname")
    if kind == "one":
        return flat(one.reads(spark, path), "name")
    if kind == "packed":
        return packed.sequences(spark, path)
    return text.fasta(spark, path, placed=placed) if kind == "fasta" else text.fastq(spark, path, placed=placed)


def make_acc_tax(spark: SparkSession, a: argparse.Namespace) -> None:
    accessions.intervals(text.accession_table(spark, a.input)).orderBy("prefix", "start").write.parquet(a.output or sinks.derived(a.input, "1acctax"))


def bam_to_reads(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = alignments(spark, a.input)
    refs = accessions.with_taxa(rows.select(F.col("rname").alias("accession")).where("accession is not null").distinct(), spark.read.parquet(a.acctax))
    sinks.written(reads.build(reads.with_taxa(rows, refs), a.mates_apart), a.output or sinks.derived(a.input, "1read"), "bam21read", a.input, buckets=a.buckets)


def tag_formats(specs: Sequence[str]) -> list[tuple[str, str]]:
    """(tag, format) of `TAG:FMT`; FMT is one of A, i, f, Z, H, B, or a type of BAM's whole numbers, which is i."""
    out = []
    for spec in specs:
        tag, _, kind = spec.partition(":")
        if not re.fullmatch("[A-Za-z][A-Za-z0-9]", tag) or kind not in set("AcCsSiIfZHB"):
            raise ValueError(f"{spec}: not TAG:FMT")
        out.append((tag, "i" if kind in "cCsSiI" else kind))
    return out


def bam_to_table(spark: SparkSession, a: argparse.Namespace) -> None:
    """Alignments with taxa of their references and chosen tags as columns, in order of reference accession and place."""
    rows = alignments(spark, a.input)
    for tag, kind in tag_formats(a.aux or []):
        rows = rows.withColumn(f"tag_{tag}", text.tag(F.col("aux"), tag, kind))
    if a.acc_tax:
        refs = accessions.with_taxa(rows.select(F.col("rname").alias("accession")).where("accession is not null").distinct(), spark.read.parquet(a.acc_tax))
        rows = reads.with_taxa(rows, refs)
    rows.drop("aux").orderBy("rname", "pos", "file", "ord").write.parquet(a.output or sinks.derived(a.input, "1bam"))


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tables with the same buckets are merged bucket by bucket, without a shuffle, into as many; others are shuffled once."""
    rows, out = bucketed.together(spark, a.inputs), a.output or "merged.1read"
    if rows is None:
        sinks.written(reads.merged(*(bucketed.read(spark, p) for p in a.inputs)), out, "merge1read", *a.inputs, buckets=a.buckets)
    else:
        sinks.written(reads.merged_sources(rows), out, "merge1read", *a.inputs, buckets=bucketed.buckets_of(spark, a.inputs[0])[0], dealt=True)


def add_lca(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads with their lowest common ancestors, and beside them the part of the tree that their taxa make up."""
    nodes = text.taxonomy_dump(spark, a.taxonomy)
    rows = reads.with_lca(bucketed.read(spark, a.input), nodes, a.score_threshold, a.max_divergence)
    out = a.output or sinks.derived(a.input, "lca.1read") if a.output != "-" else a.input
    if out == a.input:
        sinks.rewritten(rows, out, "addLCA", a.input)
    else:
        sinks.written(rows, out, "addLCA", a.input)
    taxonomy.write_subset(taxonomy.closure(reads.taxa(bucketed.read(spark, out)), nodes), out + ".1tax")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy dump, or the part of a tree that addLCA has written."""
    return taxonomy.read_subset(spark, path) if path.endswith(".1tax") else text.taxonomy_dump(spark, path)


def report_lca(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.report(reports.by_taxon(bucketed.read(spark, a.input), tree(spark, a.taxonomy), a.rank, a.group), a.output or sinks.derived(a.input, "reportLCA"))


def extract_reads(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.written(reads.below(bucketed.read(spark, a.input), tree(spark, a.taxonomy), a.lca), a.output or sinks.derived(a.input, f"{a.lca}.1read"), f"extractReads {a.lca}", a.input)


def report_reads(spark: SparkSession, a: argparse.Namespace) -> None:
    """One folder with a table of each kind, and all of them as one text."""
    rows, out = bucketed.read(spark, a.input), a.output or sinks.derived(a.input, "report1read")
    tables = reports.of_reads(rows)
    for title, df in tables.items():
        df.coalesce(1).write.csv(f"{out}/{title}", sep="\t", header=True)
    lines = []
    for title in tables:  # tables of a few hundred rows each, whatever the reads
        told = spark.read.csv(f"{out}/{title}", sep="\t", header=True)
        lines += [title, "\t".join(told.columns), *("\t".join("" if v is None else str(v) for v in r) for r in told.collect()), ""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{out}/REPORT")


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    """All alignments in order of name, under one header. Inputs that are in order are merged, with --merge; the header isn't trimmed then.

    What this writes can be read by every command and merged again: a folder of SAM parts with its header, or of BAM parts.
    """
    out = a.output or sinks.derived(a.inputs[0], "merged.sam" if a.merge else "sorted.sam")
    heads = [headers(spark, p) for p in a.inputs]
    whole = reduce(DataFrame.unionByName, heads)
    if a.merge:
        lines = merging.merged(spark, a.inputs).select("value")
    else:
        rows = sorting.by_name(*(alignments(spark, p) for p in a.inputs))
        whole = whole if a.keep_header else sorting.used_references(whole, rows)
        lines = sinks.sam_lines(rows)
    header = sinks.header_lines(sorting.united(whole))
    try:
        if out.endswith(".bam"):
            bam.write_lines(lines, out, header)
        else:
            sinks.sam(lines, header, out, "gzip" if a.gz else "none")
    except PythonException as e:
        said = re.search("[^ \n]+ isn't in order of name", str(e))
        raise merging.Disordered(said[0]) from None if said else e


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sequences(spark, a.input, placed=True)
    rows = sinks.named(rows, *(c for c in text.PLACE if c in rows.columns))
    if a.quantise is not None:
        rows = rows.withColumn("qual", F.array_join(F.transform(S.quantised(S.phred(F.col("qual")), a.quantise), lambda q: F.char(q + 33)), ""))
    if a.upper:
        rows = rows.withColumn("seq", F.upper("seq"))
    if a.break_gaps is not None:
        rows = scaffolds.broken(rows, a.break_gaps)
    if a.join:
        rows = scaffolds.joined(rows)
    if a.collapse:
        ends = F.concat(F.lit("runs="), F.array_join(S.run_ends(F.col("seq")).cast("array<string>"), ","))
        rows = rows.select("id", F.concat_ws(" ", "description", ends).alias("description"), S.collapsed(F.col("seq")).alias("seq"), F.lit(None).cast("string").alias("qual"))
    if a.expand:
        ends = F.split(F.regexp_extract("description", "runs=([0-9,]*)$", 1), ",")
        ends = F.filter(F.transform(ends, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
        rows = rows.select("id", F.nullif(F.regexp_replace("description", " ?runs=[0-9,]*$", ""), F.lit("")).alias("description"), S.expanded(F.col("seq"), ends).alias("seq"), F.lit(None).cast("string").alias("qual"))
    out = a.output or sinks.derived(a.input, "1read" if a.container else "bin" if a.packed else "fa" if a.fasta else "fq")
    if a.container:
        nothing = {c: F.lit(None) for c in ("max_score", "mline", "dust", "lca")}
        one.write_reads(rows.select(F.col("id").alias("name"), "seq", "qual").withColumns({c: v.cast("string" if c == "mline" else "int") for c, v in nothing.items()}).withColumn("tax", F.array().cast(TAX)), out)
    elif a.packed:
        packed.write(rows, out, 30 if a.quantise is None else a.quantise)
    else:
        lines = sinks.fasta_lines(rows) if a.fasta else sinks.fastq_lines(rows)
        blocked.write(lines, out) if a.gz else lines.write.text(out)


def view(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads of a table or container as lines: all, by number (i or i-j, the end excluded), or the head, or the schema, alone."""
    table = a.input.endswith((".parquet", ".1read"))
    if a.head and table:
        for k, v in sinks.about(spark, a.input).items():
            print(k, v)
        return
    if a.head or a.schema:
        told = container.head(a.input) if not table else []
        print("\n".join(container.schema_lines(told) if a.schema else told) if not table else bucketed.plain(spark, a.input).schema.simpleString())
        return
    rows = bucketed.read(spark, a.input) if table else one.reads(spark, a.input)
    if a.index:
        ranges = [(int(x), int(y) if y else None) for x, _, y in (i.partition("-") for i in a.index)]
        indexed = table and bucketed.indexed(spark, a.input)
        rows = (bucketed.slices(spark, a.input, ranges) if indexed else sorting.slices(sorting.with_row_ids(rows, "name"), ranges)).drop("row_id")
    if a.output:
        one.write_reads(rows, a.output)
    else:
        for r in one.read_lines(rows).toLocalIterator():
            print(r["value"])


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics worked out anew beside the stored ones, and the bytes that each kind of line takes. --header stores them: beside a
    table, or as a container's header, which is told or written to -o. --check SCHEMA refuses a container that a schema file doesn't fit."""
    if not a.input.endswith((".parquet", ".1read")):
        if a.check:
            wanted = [r.value.split(" ")[:-1] if r.value.endswith(" ") else r.value.split(" ") for r in spark.read.text(a.check).collect()]  # a few lines
            own = container.Schema(container.head(a.input)).fields
            for f in (w for w in wanted if w and w[0] in "OD" and len(w) > 2):
                types = [f[4 + 2 * i] for i in range(int(f[2]))]
                if f[1] in own and own[f[1]] != types:
                    raise ValueError(f"{a.input}: lines {f[1]} hold {own[f[1]]}, not {types}")
        if a.header:
            lines = container.regenerated(spark, a.input)
            if a.output:
                spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(a.output)
            else:
                print("\n".join(lines))
        else:
            container.validated(spark, a.input).orderBy("letter", "field").show(300, truncate=False)
        return
    if a.header:
        sinks.restated(spark, a.input)
    rows = bucketed.read(spark, a.input)
    reads.validated(reads.statistics(rows), sinks.stored(spark, a.input)).orderBy("field").show(100, truncate=False)
    if a.usage:
        one.bytes_by_letter(rows).orderBy("letter").show(100, truncate=False)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sequences(spark, a.input)
    told = [reports.lengths(rows, F.length("seq"))]
    told += [reports.composition(rows)] if a.bases else []
    told += [reports.qualities(rows)] if a.qualities else []
    told += [reports.coarse_bins(reports.length_bins(rows, F.length("seq")))] if a.lengths else []
    told += [reports.identifiers(rows, "id")] if a.identifiers else []
    for df in told:
        df.show(300, truncate=False)


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="readlake")
    sub = p.add_subparsers(required=True)

    def command(name: str, f, *inputs: str, **options) -> None:
        c = sub.add_parser(name)
        for i in inputs:
            c.add_argument(i, **({"nargs": "+"} if i == "inputs" else {}))
        c.add_argument("-o", "--output")
        for k, kw in options.items():
            c.add_argument("--" + k.replace("_", "-"), **kw)
        c.set_defaults(run=f)

    yes, dealt = {"action": "store_true"}, {"type": int, "default": bucketed.BUCKETS}
    command("makeAccTax", make_acc_tax, "input")
    command("bam21read", bam_to_reads, "acctax", "input", mates_apart=yes, buckets=dealt)
    command("bam21bam", bam_to_table, "input", acc_tax={}, aux={"action": "append", "metavar": "TAG:FMT"})
    command("merge1read", merge, "inputs", buckets=dealt)
    command("addLCA", add_lca, "taxonomy", "input", score_threshold={"type": int}, max_divergence={"type": float})
    command("reportLCA", report_lca, "taxonomy", "input", rank={}, group={})
    command("extractReads", extract_reads, "taxonomy", "input", lca={"type": int, "required": True})
    command("report1read", report_reads, "input")
    command("bamsort", sort, "inputs", gz=yes, keep_header=yes, merge=yes)
    command("seqconvert", convert, "input", fasta=yes, container=yes, gz=yes, quantise={"type": int}, upper=yes, break_gaps={"type": int, "nargs": "?", "const": 20}, join=yes, packed=yes, collapse=yes, expand=yes)
    command("seqstat", statistics, "input", bases=yes, qualities=yes, lengths=yes, identifiers=yes)
    command("view", view, "input", index={"action": "append"}, head=yes, schema=yes)
    command("stat", validate, "input", usage=yes, header=yes, check={"metavar": "SCHEMA"})
    a = p.parse_args(args)
    a.run(session(), a)


if __name__ == "__main__":
    main()
