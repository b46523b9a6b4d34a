"""Languages of whole texts and of spans within them (operator 2).

Each word is scored for each language by its character trigrams under smoothed, hashed counts.
The script of a word narrows the languages that it may have; a word whose script no language was
seen with scores for none. Viterbi over the words' scores, with a penalty for each switch, labels spans.

A text whose words all lie with one language needs no Viterbi: if no stretch of words prefers
another language by half the penalty, the constant labelling is the best one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.ragged import PIECE_BYTES, mix, slices
from readlake.llm.tables import lean, small_batches

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
PENALTY = 16.0
#: A word is known if its mean trigram is no less likely than a text's own by so many standard errors.
DOUBT = 3.0
REMEMBER = 200_000

#: First code points of runs of blocks, and the script of each (Unicode's block list).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, their words' numbers, each word's script and letters. Words are of lower case."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    row = np.repeat(np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        h = mix(codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9))
    same = row[2:] == row[:-2]
    first = codes[np.cumsum(lengths) - lengths + 1].astype(np.int64)
    script = _SCRIPT[np.searchsorted(_FROM, first, "right") - 1]
    letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
    return (h[same] % np.uint64(BUCKETS)).astype(np.int64), row[:-2][same], script, letters


@dataclass
class Model:
    """Log probabilities of the trigram buckets, their mean and spread over a language's own text, and allowed scripts, by language."""

    languages: list[str]
    table: np.ndarray  # bucket, language
    allowed: np.ndarray  # script, language
    usual: np.ndarray  # mean and standard deviation, language
    penalty: float = PENALTY
    place: dict = field(default_factory=dict, repr=False)
    scores: np.ndarray = field(default=None, repr=False)
    letters: np.ndarray = field(default=None, repr=False)
    familiar: np.ndarray = field(default=None, repr=False)

    def learn(self, words: set[str]) -> None:
        """Scores of the words not yet known; what is known is bounded."""
        new = sorted(words - self.place.keys())
        if len(self.place) + len(new) > REMEMBER:
            self.place, self.scores = {}, None
            new = sorted(words)
        if not new:
            return
        bucket, row, script, letters = features(new)
        firsts = np.searchsorted(row, np.arange(len(new)))
        out = np.add.reduceat(self.table[bucket], firsts, axis=0)
        allowed = self.allowed[script]
        # a word is known if in some language its trigrams are as likely as a text's own are, but for DOUBT standard errors
        n = np.diff(np.r_[firsts, len(row)])[:, None]
        familiar = (allowed & (out / n >= self.usual[0] - DOUBT * self.usual[1] / np.sqrt(n))).any(1)
        out = np.where(allowed.any(1)[:, None], np.where(allowed, out, -1e4), 0.0) * (letters > 0)[:, None]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.scores = out if self.scores is None else np.concatenate([self.scores, out])
        self.letters = letters if len(self.place) == len(new) else np.concatenate([self.letters, letters])
        self.familiar = familiar if len(self.place) == len(new) else np.concatenate([self.familiar, familiar])

    def label(self, words: list[str]) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Spans (first word, word after the last, language), the words' letters, whether they score and whether they are known."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        s, letters = self.scores[at], self.letters[at]
        best = int(s.sum(0).argmax())
        against = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), against[:-1]]), axis=0)
        if (against - low).max() < self.penalty / 2:
            return [(0, len(words), best)], letters, s.any(1), self.familiar[at]
        return viterbi(s, self.penalty), letters, s.any(1), self.familiar[at]


def viterbi(scores: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """The spans of the best labelling: sum of scores less the penalty for each switch; the first of equals."""
    total, come = np.zeros(scores.shape[1]), []
    for s in scores:
        top = int(total.argmax())
        stay = total >= total[top] - penalty
        come.append(np.where(stay, -1, top))
        total = np.where(stay, total, total[top] - penalty) + s
    state, end, spans = int(total.argmax()), len(scores), []
    for i in range(len(scores) - 1, -1, -1):
        prev = int(come[i][state])
        if prev >= 0 and prev != state and i:
            spans.append((i, end, state))
            state, end = prev, i
    return [(0, end, state), *reversed(spans)]


def train(docs: DataFrame, bound: int = 20_000, lang_col: str = "lang", text_col: str = "text", order_by: Column | None = None) -> Model:
    """A model from about bound rows with a text and a language, spread evenly over the languages.

    Bound is a documented parameter: rows are chosen by a hash of order_by (the text, if None). The
    driver holds trigram counts of a fixed number of buckets for each language. Raises ValueError if
    no row has both text and language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(order_by if order_by is not None else F.col(text_col)), F.lit(1_000_000)).alias("draw")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled text to learn languages from")
    languages = sorted(counts)
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(1_000_000 * min(1.0, bound / len(languages) / n)))) for k, n in counts.items()))
    taken = rows.where(F.col("draw") < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(2 * BUCKETS + len(NAMES), np.int64) for k in languages}  # trigrams, scripts, trigrams of each text's distinct words
        for b in slices(batches, "text", PIECE_BYTES):
            by: dict[str, tuple[list[str], list[str]]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(t.lower())
                for some, more in zip(by.setdefault(k, ([], [])), (words, set(words)), strict=True):
                    some.extend(more)
            for k, (words, distinct) in by.items():
                if words:
                    bucket, _, script, letters = features(words)
                    sums[k] += np.r_[np.bincount(bucket, minlength=BUCKETS), np.bincount(script, letters, len(NAMES)).astype(np.int64), np.bincount(features(distinct)[0], minlength=BUCKETS)]
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    found = taken.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((2 * BUCKETS + len(NAMES), len(languages)))
    for r in found:
        n[r.bucket, languages.index(r.lang)] = r.n
    grams, scripts, distinct = n[:BUCKETS] + 0.5, n[BUCKETS : BUCKETS + len(NAMES)], n[BUCKETS + len(NAMES) :]
    # what the trigrams of a text's words are like if it isn't learned from, each with one occurrence less; a word repeated in a text counts once
    own, share = np.log(np.maximum(grams - 1, 0.5) / (grams.sum(0) - 1)), distinct / np.maximum(distinct.sum(0), 1)
    mean = (share * own).sum(0)
    return Model(languages, np.log(grams / grams.sum(0)), scripts >= np.maximum(1, 0.01 * scripts.sum(0)), np.stack([mean, np.sqrt((share * (own - mean) ** 2).sum(0))]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(id, *keep, lang_pred, score, letters, known, spans) of every row, with_text the text too; no shuffle.

    spans: array of (start, end, lang) in code points of the text. lang_pred is the language with
    the most letters in spans, score the share of all letters that lie there in words that scored. letters counts those of the
    text, known is their share in words that look like one of the languages: whose trigrams are as likely there as a text's own.
    A text that is null or has no letter is `und` with score 0 and no spans; one in a script that no language
    was seen with gets a learned language with score 0. Repeated rows are labelled each.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    kept = rows.columns[:-1]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", lang_pred string, score double, letters long, known double, spans array<struct<start int, end int, lang string>>" + ", text string" * with_text
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.table.astype(np.float32), model.allowed, model.usual, model.penalty))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in slices(batches, "text", PIECE_BYTES):
            texts = b.column(len(kept)).to_pylist()
            split = [WORD.findall(t.lower()) if t else [] for t in texts]
            m.learn(set(chain.from_iterable(split)))
            out = [labelled(m, t, w) for t, w in zip(texts, split, strict=True)]
            lang, score, letters, known, spans = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            told = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64()), pa.array(known, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *told, *[b.column(len(kept))] * with_text], [*kept, "lang_pred", "score", "letters", "known", "spans", *["text"] * with_text])

    out = rows.mapInArrow(lean(label), schema)
    return out.withColumnsRenamed({"key": id_col, "text": text_col} | {f"keep_{i}": c for i, c in enumerate(keep)})


def labelled(m: Model, text: str | None, words: list[str]) -> tuple[str, float, int, float, list[dict]]:
    spans, letters, scored, familiar = m.label(words) if words else ([], np.zeros(0), np.zeros(0), np.zeros(0))
    if not letters.any():
        return "und", 0.0, 0, 0.0, []
    of = np.zeros(len(m.languages))
    sure = np.zeros(len(m.languages))
    for a, z, k in spans:
        of[k] += letters[a:z].sum()
        sure[k] += (letters[a:z] * scored[a:z]).sum()
    best = int(of.argmax())
    places = places_of(text, words, {i for a, z, _ in spans for i in (a, z - 1)})
    return m.languages[best], float(sure[best] / letters.sum()), int(letters.sum()), float((letters * familiar).sum() / letters.sum()), [{"start": places[a][0], "end": places[z - 1][1], "lang": m.languages[k]} for a, z, k in spans]


def places_of(text: str, words: list[str], wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Where some words stand; lower case may change a text's length, so the text itself is searched."""
    ends = {0, len(words) - 1}
    if wanted <= ends and len(text.lower()) == len(text):
        low = text.lower()
        a, z = low.index(words[0]), low.rindex(words[-1])
        return {0: (a, a + len(words[0])), len(words) - 1: (z, z + len(words[-1]))} if len(words) > 1 else {0: (a, a + len(words[0]))}
    found = {i: m.span() for i, m in enumerate(WORD.finditer(text)) if i in wanted}
    last = max(found.values(), default=(0, len(text)))
    return {i: found.get(i, last) for i in wanted}
