"""Spelling variants of the words of a corpus (operator 11).

Words are counted with partial sums before the shuffle. Each word that is left emits itself and its distinct single
deletions as 64-bit keys; words that share a key are candidates. Two words at a distance of one share exactly one
key, so no pair comes twice: the longer one's deletion is the shorter one, or deleting where they differ leaves the same rest.
Keys are taken from running sums, so a word of any length costs its length, and rows of keys hold numbers alone:
words come back for the exact check of each candidate. How many words share a key is bounded by what one more code
point can make of it, not by the corpus.

The near word of the largest count is a word's form if it is frequent enough; forms lead to roots by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.ragged import U64, mix, slices
from readlake.llm.tables import cut, lean, small_batches

_BASE = 0x9E3779B97F4A7C15


def runs(docs: DataFrame, letters: str, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) of every maximal run of at least so many letters (the inside of a character class) in whole texts.

    A null or empty text has none; the id is told as text, a null one as empty; other columns are left out.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def group(words: DataFrame, word_col: str = "word", least: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs at least so often.

    n_near is the number of such words at a distance of exactly one inserted, deleted or replaced code point. form is the
    near word of the largest n, of equals the smallest in the order of code points, if that n is at least factor times
    the word's own; else null, as is form_n. root is where following forms ends, the word itself without a form.
    Null words are none, an empty word is one; a row of words counts as often as it is there; other columns are left
    out; an empty table gives an empty one. factor has to be above 1, so that counts grow along forms and no path goes round.
    """
    if factor <= 1:
        raise ValueError("factor has to be above 1")
    counted = words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    known = cut(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = near_pairs(known)
    both = near.select(F.explode(F.array(*(F.struct(F.col(f"{a}.id").alias("id"), F.col(f"{b}.word").alias("word"), F.col(f"{b}.n").alias("n")) for a, b in (("a", "b"), ("b", "a"))))).alias("x")).select("x.*")
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("best"))
    top = -F.col("best.n")
    has = top >= factor * F.col("n")
    table = cut(known.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, top).alias("form_n")))
    found = roots(table.where("form is not null").select("word", "form"))
    joined = table.join(found.withColumnRenamed("word", "_of"), F.col("word") == F.col("_of"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def near_pairs(known: DataFrame) -> DataFrame:
    """(a, b) of words (id, word, n) at a distance of exactly one, each pair once, as structs (id, word, n)."""
    small_batches(known.sparkSession)
    keys = known.select("id", "word").mapInArrow(lean(keyed), "key long, id long")
    shared = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    whole = known.select("id", F.struct("id", "word", "n").alias("row"))
    pairs = shared
    for side in ("a", "b"):
        pairs = pairs.join(whole.select(F.col("id").alias(side), F.col("row").alias(f"{side}_row")), side)
    exact = F.levenshtein(F.col("a_row.word"), F.col("b_row.word"), 1) == 1
    return pairs.where(exact).select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of each word (id, word) itself and of its distinct single deletions."""
    for b in slices(batches, "word"):
        words = b.column(1).to_pylist()
        row, key = keys_of(words)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(b.column(0).to_numpy()[row])], ["key", "id"])


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and keys: a word's key is the sum of its code points' hashes times powers of a base, and that of
    a deletion the part before it and the part behind it moved up by one place. Of equal code points in a row the first is deleted."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(words)), lengths)
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(codes) + 1, _BASE), _powers(len(codes) + 1, inverse)
        sums = np.r_[U64(0), np.cumsum(mix(codes + U64(1)) * up[:-1])]
        ends = starts + lengths
        at = np.arange(len(codes))
        first = starts[row]
        cut_out = ((sums[at] - sums[first]) + (sums[ends[row]] - sums[at + 1]) * U64(inverse)) * down[first]
        whole = (sums[ends] - sums[starts]) * down[starts]
        new = np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])][: len(codes)]
        return np.r_[np.arange(len(words)), row[new]], mix(np.r_[whole + lengths.astype(U64), (cut_out + (lengths[row] - 1).astype(U64))[new]])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): where following forms ends. Each round doubles how far a word sees,
    so rounds are the logarithm of the longest path; the lineage is cut in each."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = links.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        links = cut(step)
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
