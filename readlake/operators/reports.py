"""Reports: by taxon, of damage along the reads, and of sequences."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import flat
from readlake.operators import taxonomy
from readlake.schemas import need
from readlake.session import cut

K = 7
ZONE = 15


def over_reference(seq: flat.Flat, line: flat.Flat) -> np.ndarray:
    """The reference's letter under each base, in capitals; `-` where it has none. Both strings of a row have the same length."""
    return flat.UPPER[np.where(line.data == ord("."), seq.data, line.data)]


def _lines(reads: DataFrame, *columns: str) -> DataFrame:
    """(*columns, seq, mline) of reads that have both, seq as long as mline."""
    need(reads, "seq", "mline")
    return reads.where("mline is not null and seq is not null").select(*columns, F.rpad("seq", F.length("mline"), "-").alias("seq"), "mline")


def placed(reads: DataFrame, nodes: DataFrame, rank: str | None = None, group: str | None = None) -> DataFrame:
    """reads with txid, their lca lifted to the rank; without one, or outside the group, they go."""
    rows = reads.withColumn("txid", F.col("lca"))
    if rank is not None:
        lifted = taxonomy.at_rank(nodes, rank).select(F.col("taxid").alias("lca"), F.col("at_rank").alias("txid"))
        rows = reads.join(lifted, "lca")
    rows = rows.where("txid is not null and txid <> 0")
    if group is not None:
        inside = nodes.where(F.col("grp") == group).select(F.col("taxid").alias("txid"))
        rows = rows.join(inside, "txid", "left_semi")
    return rows


#: Kinds of counts beside those of k-mers: letters, Cs of the reference under the first base, and such that read T.
LETTER, FIRST_C, FIRST_C_AS_T = 0, 4, 5
KMER = 8


def letter_counts(rows: DataFrame, key: str = "txid", k: int = K) -> DataFrame:
    """(key, kind, n): how often each letter and each k-mer of the reference stands under the reads of a key.

    A k-mer is a number, the smaller one of its own and its reverse complement's. Each batch is counted as a whole, so
    a task gives out a row for each key and kind of a batch, and only counts are shuffled.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        number, names = b.column(0).dictionary_encode(), None
        names, number = number.dictionary, number.indices.to_numpy()
        seq, line = flat.Flat(b.column(1)), flat.Flat(b.column(2))
        codes = flat.ACGT[over_reference(seq, line)]
        row = seq.rows()
        own = number[row]
        found = [flat.counted(own[codes < 4], codes[codes < 4].astype(np.int64) + LETTER)]
        full = np.flatnonzero(seq.lengths > 0)
        first = seq.offsets[:-1][full]
        c = codes[first] == 1
        found.append(flat.counted(number[full][c], np.full(int(c.sum()), FIRST_C)))
        c = (line.data[first] == ord("C")) & (flat.ACGT[seq.data[first]] == 3)
        found.append(flat.counted(number[full][c], np.full(int(c.sum()), FIRST_C_AS_T)))
        m = len(codes) - k + 1
        if m > 0:
            there, back, whole = np.zeros(m, np.int64), np.zeros(m, np.int64), row[:m] == row[k - 1 :]
            for i in range(k):
                x = codes[i : i + m].astype(np.int64)
                whole &= x < 4
                there, back = there * 4 + x, back + ((3 - x) << 2 * i)
            found.append(flat.counted(own[:m][whole], np.minimum(there, back)[whole] + KMER))
        keys, kinds = (np.concatenate([f[0][i] for f in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([names.take(pa.array(keys)), pa.array(kinds.astype(np.int32)), pa.array(np.concatenate([f[1] for f in found]))], [key, "kind", "n"])

    counts = _lines(rows, key).mapInArrow(flat.sliced(count, "seq"), f"{key} {types[key]}, kind int, n long")
    return counts.groupBy(key, "kind").agg(F.sum("n").alias("n"))


def entropy(k: int = K) -> Column:
    """Of a group's (kind, n): the entropy of its k-mers in thousandths of its maximum; null without any."""
    n = F.when(F.col("kind") >= KMER, F.col("n"))
    kinds = 2 * k - 1  # log2 of how many there are
    return F.floor(1000 * (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)) / kinds + 1e-9).cast("int")


def kmer_entropy(rows: DataFrame, key: str = "txid", k: int = K) -> DataFrame:
    """(key, hscore) of reads (key, seq, mline) by the k-mers of A, C, G, T of their reference; null without any."""
    return letter_counts(rows, key, k).groupBy(key).agg(entropy(k).alias("hscore"))


def by_taxon(reads: DataFrame, nodes: DataFrame, rank: str | None = None, group: str | None = None) -> DataFrame:
    """One row for each taxon: reads, means of length, score, dust and GC, C to T at the first base, hscore, family.

    nodes need family and grp (taxonomy.annotated). Reads without lca go; means are exact doubles.
    """
    need(nodes, "taxid", "name", "rank", "family", "grp")
    rows = placed(reads, nodes, rank, group).select("txid", "seq", "mline", "max_score", "dust")
    one = rows.groupBy("txid").agg(F.count(F.lit(1)).alias("count"), F.avg(F.length("seq")).alias("av_len"), F.avg("max_score").alias("av_score"), F.avg("dust").alias("av_dust"))

    def n(kind: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("bigint"))

    letters = letter_counts(rows).groupBy("txid").agg(*(n(LETTER + i).alias(f"n{b}") for i, b in enumerate("ACGT")), n(FIRST_C).alias("n_c1"), n(FIRST_C_AS_T).alias("n_c1_t"), entropy().alias("hscore"))
    gc = (F.col("nC") + F.col("nG")) / F.nullif(F.col("nA") + F.col("nC") + F.col("nG") + F.col("nT"), F.lit(0))
    named = nodes.select(F.col("taxid").alias("txid"), F.col("name").alias("tax_name"), F.col("rank").alias("tax_rank"), "family")
    families = nodes.select(F.col("taxid").alias("family"), F.col("name").alias("family_name"))
    out = one.join(letters, "txid", "left").fillna(0, ["n_c1", "n_c1_t"]).join(named, "txid").join(families, "family", "left")
    return out.select(F.col("txid").alias("tax_id"), "tax_name", "tax_rank", "count", "av_len", "av_score", "av_dust", gc.alias("av_gc"), "n_c1", "n_c1_t", F.when(F.col("n_c1") > 0, F.col("n_c1_t") / F.col("n_c1")).otherwise(0.0).alias("c_to_t"), F.coalesce("hscore", F.lit(0)).alias("hscore"), F.coalesce("family_name", F.lit("-")).alias("family"))


def top_taxa(report: DataFrame, k: int) -> DataFrame:
    return report.orderBy(F.desc("count"), "tax_id").limit(k)


def substitutions(reads: DataFrame, zone: int = ZONE) -> DataFrame:
    """(zone, pos, ref, base, n): bases over the reference's, by place within the first and last `zone` bases, else in the middle.

    The start goes before the end in short reads; places count from 1 at either end, the middle's is 0. Batches are counted
    as wholes: a task gives out a row for each kind of a batch.
    """
    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        seq, line = flat.Flat(b.column(0)), flat.Flat(b.column(1))
        base, ref = flat.ACGT[seq.data], flat.ACGT[over_reference(seq, line)]
        some = (base < 4) & (ref < 4)
        at = seq.places()[some]
        back = np.repeat(seq.lengths, seq.lengths)[some] - 1 - at
        where = np.where(at < zone, 0, np.where(back < zone, 1, 2))
        pos = np.where(at < zone, at + 1, np.where(back < zone, back + 1, 0))
        (where, pos, ref, base), n = flat.counted(where, pos, ref[some].astype(np.int64), base[some].astype(np.int64))
        letters = pa.array(list("ACGT"))
        return pa.RecordBatch.from_arrays([pa.array(["start", "end", "mid"]).take(pa.array(where)), pa.array(pos.astype(np.int32)), letters.take(pa.array(ref)), letters.take(pa.array(base)), pa.array(n)], ["zone", "pos", "ref", "base", "n"])

    counts = _lines(reads).mapInArrow(flat.sliced(count, "seq"), "zone string, pos int, ref string, base string, n long")
    return counts.groupBy("zone", "pos", "ref", "base").agg(F.sum("n").alias("n"))


def damage(counts: DataFrame) -> DataFrame:
    """(zone, pos, c_to_t, g_to_a, other): shares of C read as T, of G read as A, of all other changes."""
    def n(cond: str) -> Column:
        return F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0))

    ct, ga, c, g = n("ref = 'C' and base = 'T'"), n("ref = 'G' and base = 'A'"), n("ref = 'C'"), n("ref = 'G'")
    rest, changed = F.sum("n") - ct - ga, n("ref <> base") - ct - ga

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.groupBy("zone", "pos").agg(share(ct, c).alias("c_to_t"), share(ga, g).alias("g_to_a"), share(changed, rest).alias("other"))


def edits(reads: DataFrame) -> DataFrame:
    """(n_edits, n): reads by the letters of their match line other than `.`."""
    return reads.where("mline is not null").groupBy(F.length(F.translate("mline", ".", "")).alias("n_edits")).agg(F.count(F.lit(1)).alias("n"))


def present(reads: DataFrame) -> DataFrame:
    """How many reads there are, how many have qualities and match lines, and the range of their scores."""
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.count("qual").alias("n_qualities"), F.count("mline").alias("n_match_lines"), F.min("max_score").alias("min_score"), F.max("max_score").alias("max_score"))


def of_reads(reads: DataFrame) -> dict[str, DataFrame]:
    """The report of a table of reads by title: what there is, lengths, scores, edits, damage, substitutions."""
    need(reads, "seq", "mline", "qual", "max_score")
    counts = cut(substitutions(reads))
    return {"READS": present(reads), "LENGTHS": lengths(reads, F.length("seq")), "SCORES": histogram(reads, "max_score").orderBy(F.desc("max_score")), "EDITS": edits(reads).orderBy("n_edits"), "DAMAGE": damage(counts).orderBy("zone", "pos"), "COUNTS": counts.orderBy("zone", "pos", "ref", "base")}


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) of its values other than null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def lengths(df: DataFrame, length: Column) -> DataFrame:
    """n, min_len, max_len, mean_len, tot_len, n50: one more than the largest length up to which less than half of all letters lie.

    Lengths are counted first; the running sum goes over their distinct values.
    """
    counts = df.groupBy(length.cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.sum(F.col("n") * F.col("len")).alias("tot_len"))
    running = counts.select("len", F.sum(F.col("n") * F.col("len")).over(W.orderBy("len").rowsBetween(W.unboundedPreceding, 0)).alias("sofar"))
    n50 = running.crossJoin(F.broadcast(total.select("tot_len"))).where("2 * sofar >= tot_len").agg(F.min("len").alias("n50"))
    return total.crossJoin(n50).select("n", "min_len", "max_len", (F.col("tot_len") / F.col("n")).alias("mean_len"), "tot_len", "n50")


def _characters(df: DataFrame, column: str) -> DataFrame:
    """(c, n): the characters of all strings. Batches are counted as wholes; those beyond ASCII one by one."""
    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        data = flat.Flat(b.column(0)).data
        n = np.bincount(data[data < 128], minlength=128)
        found = {chr(i): int(n[i]) for i in np.flatnonzero(n)}
        if (data >= 128).any():
            found.update(Counter(x for s in b.column(0).to_pylist() if s for x in s if ord(x) >= 128))
        return pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["c", "n"])

    rows = df.select(F.col(column).alias("s")).where("s is not null")
    return rows.mapInArrow(flat.sliced(count, "s"), "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))


def composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(base, n, percent): letters of all sequences, case kept."""
    counts = _characters(df, seq)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(F.col("c").alias("base"), "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def qualities(df: DataFrame, qual: str = "qual") -> DataFrame:
    """(q, n, percent, cum_percent) of phred values in strings."""
    rows = _characters(df, qual).select((F.ascii("c") - 33).alias("q"), "n")
    order = W.orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))
    return rows.withColumn("sofar", F.sum("n").over(order)).crossJoin(total).select("q", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), (100.0 * F.col("sofar") / F.col("total")).alias("cum_percent"))


def length_bins(df: DataFrame, length: Column) -> DataFrame:
    """(bin, n, tot_len): sequences by the floor of ten times the root of their length."""
    return df.select(length.alias("len")).groupBy(F.floor(10 * F.sqrt("len")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").cast("bigint").alias("tot_len"))


def approximate_n50(bins: DataFrame) -> DataFrame:
    """n50 from length_bins: i (i + 1) / 100 for the bin i after which half of all letters are reached."""
    order = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rows = bins.withColumn("sofar", F.sum("tot_len").over(order)).crossJoin(F.broadcast(bins.agg(F.sum("tot_len").alias("total"))))
    i = F.min("bin") + 1
    return rows.where("2 * sofar >= total").agg(F.floor(i * (i + 1) / 100).cast("bigint").alias("n50"))


def coarse_bins(bins: DataFrame, parts: int = 20) -> DataFrame:
    """(len, n): about `parts` groups of the bins, each told by its largest length; with fewer bins each stands alone."""
    d = F.greatest(F.lit(1), F.floor((F.col("top") + 1) / parts))
    rows = bins.crossJoin(F.broadcast(bins.agg(F.max("bin").alias("top"))))
    last = F.col("top") - d * F.floor((F.col("top") - F.col("bin")) / d)
    return rows.groupBy(F.floor(last * last / 100).cast("bigint").alias("len")).agg(F.sum("n").alias("n"))


def identifiers(df: DataFrame, name: str = "name") -> DataFrame:
    """max_length, shared_prefix, shared_prefix_length of all names; the common front of all is that of the least and the greatest."""
    from readlake.functions.sequences import common_prefix

    ends = df.agg(F.max(F.length(name)).alias("max_length"), F.min(name).alias("low"), F.max(name).alias("high"))
    return ends.select("max_length", common_prefix(F.col("low"), F.col("high")).alias("shared_prefix")).withColumn("shared_prefix_length", F.length("shared_prefix"))
