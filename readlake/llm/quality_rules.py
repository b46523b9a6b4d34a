"""Quality by a learned decision list over statistics of a text (operator 6).

Statistics come from whole texts, batch by batch. The list is learned by sequential covering: a
rule grows one threshold after another on two thirds of the labelled rows (by FOIL's gain), is
pruned on the other third, and stands if it is right often enough: over all rows that it covers, and as far as the
few rows of the third can tell (by the upper end of Wilson's interval). What it covers is set aside and the
next rule is grown; rows of a rule that doesn't stand are set aside for growing alone. The rules leave as one
ordered Spark expression. Neither the number of rules nor that of conditions is limited: each rule covers three
rows that no rule before does, each condition gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.ragged import NOT_SPACE, Texts, mix, slices, windows
from readlake.llm.tables import lean, sized, small_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; no shuffle.

    A null or empty text has zeros; repeated rows are measured each; columns other than id and keep
    are left out; an empty table gives an empty one. Lines and windows are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    kept = rows.columns[:-1]
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{s} long" for s in STATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = measured(Texts(b.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, found)], [*kept, *STATS])

    out = rows.mapInArrow(lean(measure), schema)
    return out.withColumnsRenamed({"key": id_col} | {f"keep_{i}": c for i, c in enumerate(keep)})


def measured(texts: Texts) -> list[np.ndarray]:
    """STATS of each text of a batch."""
    starts, ends, doc = texts.words(NOT_SPACE)
    n_words = np.bincount(doc, minlength=texts.n)
    first = (texts.data & 0xC0) != 0x80  # a code point's first byte
    chars = np.r_[0, np.cumsum(first)]
    word_chars = np.bincount(doc, chars[ends] - chars[starts], texts.n).astype(np.int64)
    symbols = np.r_[0, np.cumsum(_SYMBOL[texts.data])][texts.offsets]
    breaks = np.flatnonzero(texts.data == 0x0A)
    line = np.searchsorted(breaks, starts)  # lines by the number of breaks before; a text's end also ends one
    new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])] if len(starts) else np.zeros(0, bool)
    of, line = doc[new], line[new]
    edges = np.r_[-1, breaks, len(texts.data)]
    a, b = np.maximum(edges[line] + 1, texts.offsets[of]), np.minimum(edges[line + 1], texts.offsets[of + 1])
    dup_lines = _repeats(texts.hashes(a, b), of, texts.n)
    values, at = windows(texts.hashes(starts, ends), doc, WINDOW)
    _, inverse, n = np.unique(mix(values ^ mix(doc[at])), return_inverse=True, return_counts=True)
    at = at[n[inverse] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=texts.n) if len(starts) else np.zeros(texts.n, np.int64)
    return [x.astype(np.int64) for x in (n_words, word_chars, np.diff(symbols), dup_lines, repeat)]


def _repeats(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values of each owner are equal to an earlier one of it."""
    _, first, counts = np.unique(mix(values ^ mix(owner)), return_index=True, return_counts=True)
    return np.bincount(owner[first], counts - 1, n) if len(values) else np.zeros(n, np.int64)


#: Features of the rules, as Spark expressions over the statistics; a text without words has zeros.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at most or at least, threshold) and its verdict."""

    conditions: tuple[tuple[str, str, float], ...]
    right: int
    wrong: int

    def expression(self) -> str:
        return " and ".join(f"{FEATURES[f]} {op} {t!r}D" for f, op, t in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        """False where a rule holds, in order; else true."""
        out = None
        for r in self.rules:
            out = (F if out is None else out).when(F.expr(r.expression()), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sample(labels: DataFrame, bound: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """About bound labelled ids, by a hash of the id; labels that are null or contradict each other are left out."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    one = ids.agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most").drop("most")
    n = labels.count()
    if n > bound:
        one = one.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return one


def learn(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: int = 1, least_right: float = 0.95) -> DecisionList:
    """The decision list for rows whose label is not good.

    Fitted on about bound labelled ids (documented parameter), all of which the driver holds as
    six numbers each; of an id's texts one counts, that of the least statistics. Without labels the list is empty and keeps everything.
    """
    one = sized(sample(labels, bound, id_col, label_col))
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(one, "label_id")
    stats = statistics(texts, "label_id", "text", ("label",)).select("label_id", "label", F.struct(*(F.expr(e).alias(f) for f, e in FEATURES.items())).alias("x"))
    stats = stats.groupBy("label_id", "label").agg(F.min("x").alias("x")).select("label_id", "label", "x.*")
    rows = stats.withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(3))).orderBy("label_id").toPandas()
    if not len(rows):
        return DecisionList(())
    return cover(rows[list(FEATURES)].to_numpy(float), (rows["label"] != good).to_numpy(), (rows["fold"] == 0).to_numpy(), least_right)


def cover(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, least_right: float) -> DecisionList:
    names, rules = list(FEATURES), []
    left = np.ones(len(bad), bool)
    grow = ~prune
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 129), method="nearest")) for j in range(x.shape[1])]
    while (left & bad & grow).sum() >= 3:
        grown = _grown(x, bad, left & grow, cuts)
        # the pruned rule, or where that is not right often enough the rule as it was grown
        for conditions in (_pruned(x, bad, left & prune, grown), grown):
            hit = left & _holds(x, conditions)
            right, wrong = int((hit & bad).sum()), int((hit & ~bad).sum())
            seen = hit & prune
            if conditions and right >= 3 and right >= least_right * (right + wrong) and _upper((seen & bad).sum(), seen.sum()) >= least_right:
                rules.append(Rule(tuple((names[j], op, float(t)) for j, op, t in conditions), right, wrong))
                left &= ~hit
                break
        else:
            hit = left & grow & _holds(x, grown)
            if not grown or not (hit & bad).any():
                break
            grow &= ~hit
    return DecisionList(tuple(rules))


def _upper(right: int, n: int, z: float = 1.645) -> float:
    """The upper end of Wilson's interval for the share of right ones, 95 % on one side; without a row nothing is known, so 0."""
    if not n:
        return 0.0
    p = right / n
    return float((p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def _holds(x: np.ndarray, conditions: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in conditions:
        out &= x[:, j] <= t if op == "<=" else x[:, j] >= t
    return out


def _grown(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> list:
    """Adds the threshold of the largest gain while wrong rows are covered."""
    conditions: list = []
    while True:
        p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for j, values in enumerate(cuts):
            bins = np.searchsorted(values, x[rows, j])
            p = np.cumsum(np.bincount(bins, bad[rows], len(values) + 1))
            n = np.cumsum(np.bincount(bins, ~bad[rows], len(values) + 1))
            for op, pos, neg in (("<=", p[:-1], n[:-1]), (">=", p[-1] - np.r_[0, p[:-2]], n[-1] - np.r_[0, n[:-2]])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - np.log2(p0 / (p0 + n0))), 0)
                if g.max() > gain:
                    gain, best = g.max(), (j, op, values[int(g.argmax())])
        if best is None:
            break
        conditions.append(best)
        rows = rows & _holds(x, [best])
    return conditions


def _pruned(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, conditions: list) -> list:
    """The front part of the conditions with the best balance of right and wrong on the rows kept for this."""
    def worth(some: list) -> float:
        hit = rows & _holds(x, some)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1

    return max((conditions[:i] for i in range(len(conditions), 0, -1)), key=worth, default=[])
