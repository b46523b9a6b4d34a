"""Functions of sequences as Spark expressions, and as Arrow functions where expressions don't reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.functions import flat
from readlake.functions.flat import COMPLEMENTS, LETTERS


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def quantised(qual: Column, threshold: int = 30) -> Column:
    """Qualities (array of int) of at least threshold as threshold, the others as 0."""
    return F.transform(qual, lambda q: F.when(q >= threshold, threshold).otherwise(0))


def phred(text: Column) -> Column:
    """Qualities of a string of printable characters from `!` on."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)


def ambiguous_to_n(seq: Column) -> Column:
    """Letters other than A, C, G, T (U counts as T) as N, case kept; what is no letter goes."""
    letters = F.regexp_replace(F.translate(seq, "Uu", "Tt"), "[^A-Za-z]", "")
    return F.regexp_replace(F.regexp_replace(letters, "[BD-FH-MO-SU-Z]", "N"), "[bd-fh-mo-su-z]", "n")


def to_index(seq: Column) -> Column:
    """A, C, G, T as digits 0 to 3, all else as 4."""
    return F.regexp_replace(F.translate(F.upper(seq), "ACGTU", "01233"), "[^0-3]", "4")


def collapsed(seq: Column) -> Column:
    """Runs of one letter as one letter; case counts."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def run_ends(seq: Column) -> Column:
    """For each run of one letter the number of letters up to its end."""
    letters, n = F.split(seq, ""), F.length(seq)  # each list is made once, outside of the functions of elements
    changes = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(n, F.lit(1))), lambda x, y: ~x.eqNullSafe(y))
    ends = F.filter(F.transform(changes, lambda new, i: F.when(new, i + 1)), lambda z: z.isNotNull())
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(ends)


def expanded(seq: Column, ends: Column) -> Column:
    """The inverse of collapsed and run_ends."""
    starts = F.concat(F.array(F.lit(0)), ends)
    runs = F.zip_with(F.arrays_zip(F.split(seq, "").alias("c"), ends.alias("z")), F.slice(starts, F.lit(1), F.size(ends)), lambda x, a: F.repeat(x["c"], x["z"] - a))
    return F.when(F.size(ends) == 0, F.lit("")).otherwise(F.array_join(runs, ""))


def contigs(seq: Column, gap: int = 20) -> Column:
    """The pieces between runs of at least gap letters other than A, C, G, T; runs at either end go, however short."""
    trimmed = F.regexp_replace(F.regexp_replace(seq, "^[^ACGTacgt]+", ""), "[^ACGTacgt]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[^ACGTacgt]{{{gap},}}"))


def gaps(seq: Column, gap: int = 20) -> Column:
    """Lengths of the runs that contigs() leaves out: the leading one, those between contigs, the trailing one.

    Without contigs the leading run is the whole sequence and the trailing one empty.
    """
    lead = F.length(F.regexp_extract(seq, "^[^ACGTacgt]*", 0))
    tail = F.when(lead == F.length(seq), 0).otherwise(F.length(F.regexp_extract(seq, "[^ACGTacgt]*$", 0)))
    trimmed = F.regexp_replace(F.regexp_replace(seq, "^[^ACGTacgt]+", ""), "[^ACGTacgt]+$", "")
    inner = F.transform(F.regexp_extract_all(trimmed, F.lit(f"[^ACGTacgt]{{{gap},}}"), F.lit(0)), F.length)
    return F.concat(F.array(lead), inner, F.array(tail))


def scaffold(pieces: Column, spaces: Column) -> Column:
    """Contigs joined again, with `n` in the gaps (lengths as gaps() gives them)."""
    joined = F.zip_with(F.slice(spaces, F.lit(1), F.size(pieces)), pieces, lambda gap, piece: F.concat(F.repeat(F.lit("n"), gap), piece))
    tail = F.repeat(F.lit("n"), F.element_at(spaces, -1))
    return F.when(F.size(pieces) == 0, F.repeat(F.lit("n"), F.get(spaces, F.lit(0)))).otherwise(F.concat(F.array_join(joined, ""), tail))


def common_prefix(low: Column, high: Column) -> Column:
    """The common front of two strings; of many strings it is that of the least and the greatest."""
    n = F.least(F.length(low), F.length(high))
    k = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, i: F.when(F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i), i).otherwise(best))
    return F.substring(low, F.lit(1), k)


def flag_number(text: Column) -> Column:
    """A flag in decimal, hexadecimal (0x) or octal (leading 0)."""
    return F.when(text.rlike("^0[xX]"), F.conv(F.substring(text, 3, 20), 16, 10)).when(text.rlike("^0[0-7]"), F.conv(text, 8, 10)).otherwise(text).try_cast("int")


#: Letters that are scored at once: some hundred bytes of arrays stand for each of them.
DUST = 1 << 20

RUNS = T.ArrayType(T.StructType().add("pos", "integer").add("base", "string").add("run", "integer"))


@F.arrow_udf(RUNS)
def exceptions(seq: pa.Array) -> pa.Array:
    """(pos, base, run) of each run of one letter other than A, C, G, T, positions from 0."""
    return flat.in_stretches(lambda x: flat.listed(*flat.exceptions(x), flat.nulls(x)), DUST, seq)


@F.arrow_udf(T.StringType())
def overlaid(seq: pa.Array, found: pa.Array) -> pa.Array:
    """The sequence with exceptions() put back over its letters."""
    return flat.in_stretches(flat.overlaid, DUST, seq, found)


@F.arrow_udf(T.StructType().add("plain", "string").add("odd", "string"))
def plain_and_odd(seq: pa.Array) -> pa.Array:
    """The sequence in small letters with `a` for all but a, c, g, t, and its exceptions as lines `N pos base run`, empty if it has none."""
    def told(x: pa.Array) -> pa.Array:
        letters, offsets = flat.codes(flat.Flat(x))
        small = np.where(flat.odd(letters), ord("a"), letters | 0x20).astype(np.uint8)
        runs, counts = flat.exceptions(x)
        pos, base, run = (runs.field(i) for i in range(3))
        lines = pc.binary_join_element_wise("N", pos.cast(pa.string()), base, run.cast(pa.string()), " ")
        return pa.StructArray.from_arrays([flat.strings(small, offsets, flat.nulls(x)), pc.binary_join(flat.listed(lines, counts, flat.nulls(x)), "\n")], ["plain", "odd"])

    return flat.in_stretches(told, DUST, seq)


@F.arrow_udf(T.StructType().add("contigs", T.ArrayType(T.StructType().add("seq", "string").add("qual", "string").add("gap", "integer"))).add("lead", "integer").add("end", "integer"))
def pieces(seq: pa.Array, qual: pa.Array, gap: pa.Array) -> pa.Array:
    """The contigs of a sequence with their qualities and the gaps before them, and the gaps at its two ends: as contigs() and gaps() give them."""
    least = gap[0].as_py() if len(gap) else 1
    return flat.in_stretches(lambda s, q: flat.contigs(s, q, least), DUST, seq, qual)


@F.arrow_udf(T.IntegerType())
def dust(seq: pa.Array) -> pa.Array:
    """flat.dust_scores, rounded to the nearest; null for a null."""
    scores = np.concatenate([flat.dust_scores(flat.Flat(seq.slice(a, z - a))) for a, z in flat.stretches(seq, DUST)])
    return pa.array(np.floor(0.5 + scores).astype(np.int32), mask=seq.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.StringType())
def mline(cigar: pa.Array, md: pa.Array, reverse: pa.Array) -> pa.Array:
    return flat.match_lines(cigar, md, reverse)
