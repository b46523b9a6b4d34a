"""Token counts of whole texts as a SentencePiece BPE model gives them (operator 7).

The model file is read as its published protobuf; only NORMAL pieces merge, in order of score.
No piece of such a model has the word mark after another character, so a text falls into
pre-tokens (marks, then other characters) that merge apart from each other. Each task counts the
distinct pre-tokens of a batch by rank-synchronous merging and adds the counts up by text.
A symbol that is no piece counts as its UTF-8 bytes (byte fallback) or as one unknown token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.merging import Pairs, merge
from readlake.llm.ragged import slices
from readlake.llm.tables import lean, small_batches

MARK = "▁"
PRE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct pre-tokens that a task keeps before it forgets them all; bounds its memory only.
REMEMBER = 200_000


@lru_cache(maxsize=2)
def model(path: str) -> PieceCounter:
    return PieceCounter(path)


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normalizer, white space kept and marked before words")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        normal = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal) or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("pieces that cross words, user-defined or unused pieces aren't supported")
        order = {s: i for i, s in enumerate(sorted({*normal.values()}, reverse=True))}
        self.symbols = {p: i for i, p in enumerate(normal)}
        for c in sorted({c for p in normal for c in p} - self.symbols.keys()):
            self.symbols[c] = len(self.symbols)
        self.pairs = Pairs(self.symbols, {p: order[s] for p, s in normal.items() if len(p) > 1})
        fallback = proto.trainer_spec.byte_fallback
        self.other = len(self.symbols)  # a character that no piece holds
        self.cost = np.array([1 if p in normal or not fallback else len(p.encode()) for p in self.symbols], np.int64)
        self.fallback, self.known = fallback, {}

    def learn(self, words: list[str]) -> None:
        """Counts of words not counted before."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        ids = np.array([self.symbols.get(chr(c), self.other) for c in chars.tolist()], np.int64)
        odd = np.array([len(chr(c).encode()) if self.fallback else 1 for c in chars.tolist()], np.int64)
        symbols = ids[inverse]
        row = np.repeat(np.arange(len(words)), lengths)
        unknown = symbols == self.other
        extra = np.bincount(row[unknown], odd[inverse][unknown], len(words)).astype(np.int64) if unknown.any() else 0
        out, n = merge(self.pairs, symbols, lengths)
        cost = np.append(self.cost, 0)[out]
        total = np.bincount(np.repeat(np.arange(len(words)), n), cost, len(words)).astype(np.int64) + extra
        self.known.update(zip(words, total.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        split = [PRE.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split))
        if len(self.known) > REMEMBER:
            self.known.clear()
        new -= self.known.keys()
        if new:
            self.learn(list(new))
        known = self.known.__getitem__
        return [sum(map(known, words)) for words in split]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; no shuffle.

    A null text is an empty one and has no tokens; repeated rows are counted each; other columns
    are left out; an empty table gives an empty one. model_path must be readable on executors.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model(model_path)
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(counter.counts(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(lean(count), f"key {key}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", id_col)
