"""Sequences broken at long gaps into contigs that know their place, and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import sequences as S

#: What a contig's description ends in: its scaffold, its number and how many there are, the gap before it, and behind the last one the gap after it.
_NOTE = r"scaffold=(\S+) part=([0-9]+)/([0-9]+) gap=([0-9]+) end=([0-9]+)$"


def broken(sequences: DataFrame, gap: int = 20) -> DataFrame:
    """(id, description, seq, qual) of the contigs between runs of at least gap letters other than A, C, G, T, under ids with their number.

    Each description ends in a note of the contig's place, from which joined() puts the sequence together. Qualities are cut along. A
    sequence without any contig stays as one empty one, so that none is lost.
    """
    taken = sequences.select("id", "description", "qual", S.pieces("seq", "qual", F.lit(gap)).alias("_p"))
    rows = taken.select("id", "description", F.col("qual").isNotNull().alias("_q"), "_p.lead", "_p.end", F.size("_p.contigs").alias("_n"), F.posexplode_outer("_p.contigs").alias("_k", "_x"))
    k = F.coalesce(F.col("_k"), F.lit(0))
    end = F.when((k + 1 >= F.col("_n")) & (F.col("_n") > 0), F.col("end")).otherwise(0)
    note = F.format_string("scaffold=%s part=%d/%d gap=%d end=%d", F.col("id"), k + 1, F.greatest("_n", F.lit(1)), F.when(F.col("_n") > 0, F.col("_x.gap")).otherwise(F.col("lead")), end)
    qual = F.when(F.col("_q"), F.coalesce("_x.qual", F.lit("")))
    return rows.select(F.concat_ws(".", "id", (k + 1).cast("string")).alias("id"), F.concat_ws(" ", F.nullif("description", F.lit("")), note).alias("description"), F.coalesce("_x.seq", F.lit("")).alias("seq"), qual.alias("qual"))


def joined(contigs: DataFrame) -> DataFrame:
    """The sequences that broken() has taken apart: contigs in order of their numbers with n in the gaps, where qualities are the lowest.

    Contigs whose description has no note come back as they are. A scaffold that lacks a contig is an error.
    """
    told = F.regexp_extract("description", _NOTE, 0)  # one search for each contig; the note's words are cut from what it found
    noted = F.coalesce(F.col("description").rlike(_NOTE), F.lit(False))
    word = lambda name: F.substring_index(F.substring_index("_t", f" {name}=", -1), " ", 1)
    number = lambda x: x.cast("int")
    parts = contigs.select("*", told.alias("_t")).where("_t <> ''").select(F.substring_index(F.substring("_t", F.lit(len("scaffold=") + 1), F.length("_t")), " ", 1).alias("id"), F.split(word("part"), "/").alias("_p"), number(word("gap")).alias("gap"), number(word("end")).alias("end"), "seq", "qual", "description")
    rows = parts.select("id", F.struct(number(F.get("_p", F.lit(0))).alias("k"), number(F.get("_p", F.lit(1))).alias("n"), "gap", "end", "seq", "qual", F.when(F.get("_p", F.lit(0)) == "1", F.col("description")).alias("description")).alias("c"))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    right = (F.size("c") == F.get("c", F.lit(0))["n"]) & (F.element_at("c", -1)["k"] == F.size("c"))

    def put(letter: str, column: str):
        filled = lambda n: F.repeat(F.lit(letter), n)
        return F.concat(F.array_join(F.transform("c", lambda x: F.concat(filled(x["gap"]), x[column])), ""), filled(F.element_at("c", -1)["end"]))

    checked = whole.withColumn("c", F.when(right, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("contigs are lacking of "), F.col("id")))))
    description = F.nullif(F.regexp_replace(F.get("c", F.lit(0))["description"], " ?" + _NOTE, ""), F.lit(""))
    back = checked.select("id", description.alias("description"), put("n", "seq").alias("seq"), F.when(F.forall("c", lambda x: x["qual"].isNotNull()), put("!", "qual")).alias("qual"))
    return contigs.where(~noted).select("id", "description", "seq", "qual").unionByName(back)
