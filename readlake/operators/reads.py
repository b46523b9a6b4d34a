"""From alignments, one row each, to reads, one row each with all that they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import sequences as S
from readlake.schemas import TAX, need

#: Fixed value: the best score of a taxon whose alignments have none.
NO_SCORE = -16384
REVERSE = 16


def with_taxa(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """alignments with the taxid of their reference (refs: accession, taxid); 0 for unknown ones and without a reference."""
    need(refs, "accession", "taxid")
    taxa = refs.select(F.col("accession").alias("rname"), "taxid")
    return alignments.join(taxa, "rname", "left").withColumn("taxid", F.coalesce("taxid", F.lit(0)))


def taxa_of(alignments: DataFrame, key: str = "qname") -> DataFrame:
    """(key, taxid, best_score, cnt) of each read and taxon."""
    need(alignments, key, "taxid", "score")
    return alignments.groupBy(key, "taxid").agg(F.coalesce(F.max("score"), F.lit(NO_SCORE)).alias("best_score"), F.count(F.lit(1)).alias("cnt"))


def best_hits(alignments: DataFrame, *columns: str, key: str = "qname", order: str = "ord") -> DataFrame:
    """(key, max_score, *columns) of the alignment with the highest score, the first of equals; reads without a score have none."""
    scored = alignments.where("score is not null")
    one = scored.groupBy(key).agg(F.max("score").alias("max_score"), F.min_by(F.struct(*columns), F.struct(-F.col("score"), order)).alias("best"))
    return one.select(key, "max_score", *(F.col(f"best.{c}").alias(c) for c in columns))


def first_records(alignments: DataFrame, *columns: str, key: str = "qname", order: str = "ord") -> DataFrame:
    """(key, *columns) of the first alignment of each read."""
    one = alignments.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("first"))
    return one.select(key, *(F.col(f"first.{c}").alias(c) for c in columns))


def as_sequenced(df: DataFrame) -> DataFrame:
    """seq and qual as they were read: turned round where the flag says that they stand reversed."""
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    return df.withColumn("seq", F.when(back, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("qual", F.when(back, F.reverse("qual")).otherwise(F.col("qual")))


def build(alignments: DataFrame, mates_apart: bool = False) -> DataFrame:
    """Reads of alignments (qname, flag, seq, qual, cigar, md, score, taxid, ord).

    Alignments are dealt by name once; in each part one sort by name and taxon serves the grouping by both and the one by
    name, so partial results by taxon meet the first record and the best one without another shuffle. mates_apart keeps the two reads of a pair apart, which share their name.
    """
    need(alignments, "qname", "flag", "seq", "qual", "cigar", "md", "score", "taxid", "ord")
    key = F.when(F.lit(mates_apart) & (F.col("flag").bitwiseAND(0xC0) != 0), F.concat("qname", F.lit("/"), F.shiftright(F.col("flag").bitwiseAND(0xC0), 6).cast("string"))).otherwise(F.col("qname"))
    rows = alignments.withColumn("name", key).repartition("name")
    by_taxon = rows.groupBy("name", "taxid").agg(
        F.coalesce(F.max("score"), F.lit(NO_SCORE)).alias("best_score"), F.count(F.lit(1)).alias("cnt"), F.max("score").alias("score"),
        F.min_by(F.struct("seq", "qual", "flag"), "ord").alias("first"), F.min("ord").alias("first_ord"),
        F.min_by(F.struct("cigar", "md", "flag"), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), "ord"))).alias("best"),
        F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")))).alias("best_ord"),
    )
    reads = by_taxon.groupBy("name").agg(
        F.min_by("first", "first_ord").alias("first"), F.max("score").alias("max_score"), F.min_by("best", "best_ord").alias("best"),
        F.array_sort(F.collect_list(F.struct("taxid", "best_score", "cnt"))).alias("tax"),
    )
    line = S.mline(F.col("best.cigar"), F.col("best.md"), F.coalesce(F.col("best.flag").bitwiseAND(REVERSE) != 0, F.lit(False)))
    flat = as_sequenced(reads.select("name", F.col("first.seq").alias("seq"), F.col("first.qual").alias("qual"), F.col("first.flag").alias("flag"), "max_score", line.alias("mline"), F.col("tax").cast(TAX).alias("tax")))
    return flat.drop("flag").select("name", "seq", "qual", "max_score", "mline", F.lit(None).cast("int").alias("dust"), F.lit(None).cast("int").alias("lca"), "tax")


def merged(*inputs: DataFrame) -> DataFrame:
    """One row for each read name of several tables of reads, which one shuffle by name brings together.

    Counts of a taxon add up, its best scores and the reads' take the maximum; the match line is that of the
    highest score, the sequence that of the first table that has the read. dust and lca are left to be worked out anew.
    """
    rows = None
    for i, reads in enumerate(inputs):
        one = reads.select(F.lit(i).alias("source"), "name", "seq", "qual", "max_score", "mline", "tax")
        rows = one if rows is None else rows.unionByName(one)
    return merged_sources(rows.repartition("name"))


def merged_sources(rows: DataFrame) -> DataFrame:
    """As merged(), of the rows of all tables with the number of their table as source.

    Rows that lie together by name, as bucketed.together() reads them, are merged where they lie. Taxa are added up as rows before they are
    nested again, so a read that hits thousands costs no more than its rows; the rest of a read goes with its first taxon.
    """
    flat = rows.select("name", "source", "seq", "qual", "max_score", "mline", F.posexplode_outer("tax").alias("at", "t"))
    head, scored = F.coalesce(F.col("at"), F.lit(0)) == 0, F.when(F.col("max_score").isNotNull(), F.struct(F.col("max_score").alias("s"), (-F.col("source")).alias("o")))
    by_taxon = flat.groupBy("name", F.col("t.taxid").alias("taxid")).agg(
        F.max("t.best_score").alias("best_score"), F.sum("t.cnt").alias("cnt"), F.max("max_score").alias("max_score"),
        F.min_by(F.struct("seq", "qual"), F.when(head, F.col("source"))).alias("first"), F.min(F.when(head, F.col("source"))).alias("source"),
        F.max_by("mline", F.when(head, scored)).alias("mline"), F.max(F.when(head, scored)).alias("best"),
    )
    taxon = F.when(F.col("taxid").isNotNull(), F.struct("taxid", "best_score", "cnt"))
    whole = by_taxon.groupBy("name").agg(F.min_by("first", "source").alias("first"), F.max("max_score").alias("max_score"), F.max_by("mline", "best").alias("mline"), F.array_sort(F.collect_list(taxon)).alias("tax"))
    return whole.select("name", F.col("first.seq").alias("seq"), F.col("first.qual").alias("qual"), "max_score", "mline", F.lit(None).cast("int").alias("dust"), F.lit(None).cast("int").alias("lca"), F.col("tax").cast(TAX).alias("tax"))


def taxa(reads: DataFrame) -> DataFrame:
    """(name, taxid, best_score, cnt) of the nested taxa."""
    return reads.select("name", F.explode("tax").alias("t")).select("name", "t.*")


def with_lca(reads: DataFrame, nodes: DataFrame, score_threshold: int | None = None, max_divergence: float | None = None) -> DataFrame:
    """reads with lca and dust.

    score_threshold: only taxa within so much of the read's best score count. max_divergence: only reads with at most
    that share of letters off the reference get an lca. Both are off as they come.
    """
    from readlake.operators import taxonomy

    rows = reads.drop("lca", "dust")
    counted = rows if max_divergence is None else rows.where(F.length(F.regexp_replace("mline", r"\.", "")) <= max_divergence * F.length("seq"))
    hits = counted.select("name", "max_score", F.explode("tax").alias("t")).select("name", "max_score", "t.taxid", "t.best_score")
    if score_threshold is not None:
        hits = hits.where(F.col("best_score") >= F.col("max_score") - score_threshold)
    found = taxonomy.lca(hits.select("name", "taxid"), nodes)
    return rows.join(found, "name", "left").withColumn("dust", S.dust("seq")).select(*reads.columns)


def below(reads: DataFrame, nodes: DataFrame, taxid: int) -> DataFrame:
    """The reads whose lca is the taxon or lies below it."""
    from readlake.operators import taxonomy

    return reads.join(taxonomy.subtree(nodes, taxid).select(F.col("taxid").alias("lca")), "lca", "left_semi").select(*reads.columns)


def statistics(reads: DataFrame) -> DataFrame:
    """n_reads, max_seq_len, tot_seq_len, max_name_len, max_tax of a table of reads."""
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.max(F.length("seq")).cast("bigint").alias("max_seq_len"), F.sum(F.length("seq")).alias("tot_seq_len"), F.max(F.length("name")).cast("bigint").alias("max_name_len"), F.max(F.size("tax")).cast("bigint").alias("max_tax"))


def validated(actual: DataFrame, stored: DataFrame) -> DataFrame:
    """(field, actual, stored, state) of two tables of one row: ok, bad, or missing where nothing is stored."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias(name)) for c in df.columns))).alias("x")).select("x.*")

    state = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("actual"), "ok").otherwise("bad")
    return tall(actual, "actual").join(tall(stored, "stored"), "field", "left").withColumn("state", state)
