"""A quality score by a sparse ensemble of rules over statistics of a text (operator 12).

Statistics come from whole texts, batch by batch, without a shuffle. A random forest of shallow trees is grown on all
labelled rows by Spark's own learner; every path from a root to a node below it is a rule, a conjunction of
thresholds. A logistic regression with the lasso's penalty weighs the rules, also on all labelled rows, and most weights
become zero. What is left is compiled into one Spark expression over the statistics: no model goes to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.quality_rules import STATS as BASE
from readlake.llm.quality_rules import measured
from readlake.llm.ragged import LOWER, NOT_SPACE, Texts, mix, slices, span_hashes
from readlake.llm.tables import cut, lean, sized, small_batches

STATS = (*BASE, "n_distinct", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
#: Features of the trees, as Spark expressions over the statistics; a text without words has zeros.
FEATURES = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC0:] = True  # beyond ASCII a code point's first byte
_DIGIT[0x30:0x3A] = True
_MARK[list(b"!?.,;:\"'()[]{}/\\-_=+~^`@")] = True


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS) of every row; no shuffle.

    A null or empty text has zeros; repeated rows are measured each; other columns are left out; an empty table gives
    an empty one. Lines, windows and words are compared by 64-bit hashes, words in lower case (A-Z only).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = Texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, [*measured(texts), *_more(texts)])], ["key", *STATS])

    return rows.mapInArrow(lean(measure), schema).withColumnRenamed("key", id_col)


def _more(texts: Texts) -> list[np.ndarray]:
    """Distinct words, lines with a word, capitals, letters, digits and punctuation marks of each text."""
    starts, ends, doc = texts.words(NOT_SPACE)
    _, first = np.unique(mix(span_hashes(LOWER[texts.data], starts, ends) ^ mix(doc)), return_index=True)
    line = np.searchsorted(np.flatnonzero(texts.data == 0x0A), starts)
    new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])] if len(starts) else np.zeros(0, bool)
    counts = [np.diff(np.r_[0, np.cumsum(kind[texts.data])][texts.offsets]) for kind in (_UPPER, _LETTER, _DIGIT, _MARK)]
    return [x.astype(np.int64) for x in (np.bincount(doc[first], minlength=texts.n), np.bincount(doc[new], minlength=texts.n), *counts)]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, `<=` or `>`, threshold), and what it adds to the log odds of a good text."""

    conditions: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        return F.expr(" and ".join(f"{FEATURES[f]} {op} {t!r}D" for f, op, t in self.conditions))

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{f} {op} {t:.4g}" for f, op, t in self.conditions)


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights; without any the share of good rows is every text's score."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of a good text as an expression over the statistics, from 0 to 1."""
        added = reduce(lambda total, r: total + F.when(r.holds(), F.lit(r.weight)).otherwise(F.lit(0.0)), self.rules, F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-added))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", good: int = 1) -> DataFrame:
    """(fold, y, features) of the rows with a label, y 1.0 for a good one; labels that are null or contradict each other are left out.

    Rows lie in an order of their own in each partition, behind a checkpoint, so that trees grow alike whatever is computed again.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    one = ids.agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most")).where("_label = _most").drop("_most")
    rows = stats.join(sized(one), F.col(id_col) == F.col("_id")).select("_id", (F.col("_label") == good).cast("double").alias("y"), *(F.expr(e).alias(f) for f, e in FEATURES.items()), *STATS)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(4))
    kept = rows.withColumn("fold", fold).repartition("_id").sortWithinPartitions("_id", *STATS)
    return cut(kept.select("fold", "y", array_to_vector(F.array(*FEATURES)).alias("features"), *STATS))


def learn(rows: DataFrame, trees: int = 24, depth: int = 3, lasso: Sequence[float] = (3e-3, 1e-3, 3e-4), seed: int = 7) -> Ensemble:
    """The ensemble for labelled() rows: trees on all of them, weights on three quarters, the penalty of the least log loss on the rest.

    Every labelled row counts; no row leaves the executors. Without rows every score is 0.5, with rows of one kind alone,
    or without any split, the share of good ones, held off 0 and 1 by half a row.
    """
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = (good + 0.5) / (n + 1)
    prior = Ensemble((), log(share / (1 - share)))
    if not 0 < good < n:
        return prior
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=3, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    rules = rules_of(forest)
    if not rules:
        return prior
    held = cut(rows.select("fold", "y", array_to_vector(F.array(*(r.holds().cast("double") for r in rules))).alias("rules")))
    fit, rest = held.where("fold <> 0"), held.where("fold = 0")
    if fit.select("y").distinct().count() < 2 or rest.isEmpty():
        fit = rest = held
    best, least = None, float("inf")
    for penalty in lasso:
        model = LogisticRegression(labelCol="y", featuresCol="rules", regParam=penalty, elasticNetParam=1.0, maxIter=60, tol=1e-5).fit(fit)
        right = F.greatest(F.get(vector_to_array("probability"), F.col("y").cast("int")), F.lit(1e-12))
        loss = model.transform(rest).agg(F.avg(-F.log(right))).first()[0]
        if loss < least:
            best, least = model, loss
    weighed = tuple(Rule(r.conditions, float(w)) for r, w in zip(rules, best.coefficients.toArray(), strict=True) if w)
    return Ensemble(weighed, float(best.intercept))


def rules_of(forest) -> list[Rule]:
    """The distinct rules of a forest: the conditions on the way to each node below a root, of each feature and side the closest."""
    found: dict[Rule, None] = {}
    names = list(FEATURES)

    def walk(node, so_far: dict) -> None:
        if so_far:
            found[Rule(tuple((names[j], op, t) for (j, op), t in sorted(so_far.items())))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            j, t = node.split().featureIndex(), node.split().threshold()
            low, high = (so_far.get((j, op)) for op in ("<=", ">"))
            walk(node.leftChild(), so_far | {(j, "<="): t if low is None else min(t, low)})
            walk(node.rightChild(), so_far | {(j, ">"): t if high is None else max(t, high)})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: int = 1) -> DataFrame:
    """(id, score) of every row of docs, by an ensemble learned from labels (id, label).

    Texts are measured once: rows of statistics stand behind a checkpoint, to be learned from and to be scored. Null and
    empty texts are scored by their zeros; repeated rows are scored each; ids that are null are scored and never learned from.
    """
    stats = cut(statistics(docs, id_col, text_col))
    return stats.select(id_col, learn(labelled(stats, labels, id_col, label_col, good)).score().alias("score"))
