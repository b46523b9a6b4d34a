"""Byte-level BPE over whole tables: every distinct word is encoded once (operator 1).

Encoding explodes the texts into pre-tokens. A block is some tens of megabytes of one input split;
within a block each distinct pre-token gets a number (the more frequent, the smaller), and a text
becomes the packed numbers of its pre-tokens in order of position. The distinct pre-tokens of all blocks are shuffled by hash, so
each is encoded by one task, once; the ids go back to the blocks that hold it, and each block puts
its texts together again by position. Between the tasks travel only distinct words of a block, never
a row for each occurrence, so a word that makes up a third of the text is one entry of each block.

Decoding joins the token-byte table, which is as small as the vocabulary, to the ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.merging import Pairs, merge
from readlake.llm.ragged import PIECE_BYTES, slices
from readlake.llm.tables import lean, partitions, small_batches

BLOCK_CHARS = 32 << 20
LONG_TEXT = 1 << 22


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Ranks of a .tiktoken file: a token in base64 and its rank in each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.number = {t: i for i, t in enumerate(tokens)}  # dense, in order of rank
        self.id_of = np.array([self.ranks[t] for t in tokens], np.int64)
        self.bytes_at = np.array([self.number.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes_at < 0).any():
            raise ValueError("a byte-level vocabulary has a token for every byte")

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.number, {t: i for t, i in self.number.items() if len(t) > 1})

    @cached_property
    def token_bytes(self) -> pa.Array:
        table = [b""] * (int(self.id_of.max()) + 1)
        for t, i in self.ranks.items():
            table[i] = t
        return pa.array(table, pa.binary())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and how many each has. A word that is a token is that token."""
        whole = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        part = np.flatnonzero(whole < 0)
        rest = [words[i] for i in part.tolist()]
        out, n = merge(self.pairs, self.bytes_at[np.frombuffer(b"".join(rest), np.uint8)], np.fromiter(map(len, rest), np.int64, len(rest)))
        counts = np.ones(len(words), np.int64)
        counts[part] = n
        ids = np.empty(int(counts.sum()), np.int64)
        of_part = np.repeat(whole < 0, counts)
        ids[of_part], ids[~of_part] = out, whole[whole >= 0]
        return self.id_of[ids], counts


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers under 2**32; the bytes of a rank lie together, which zstd likes."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _split(pattern, text: str) -> Iterator[str]:
    if len(text) < LONG_TEXT:
        yield from pattern.findall(text)
        return
    found = pattern.finditer(text)  # one list of a very long text's words would be large
    while some := [m.group() for m in islice(found, 1 << 16)]:
        yield from some


#: Rows of the first step. kind 0: some texts of a block, with the numbers of their pre-tokens in
#: data and how many each text has in counts; kind 1: the words of a block that fall to a slot, in
#: ascending order of their numbers, with the words in data, their lengths in counts and the steps
#: from number to number in steps. ord keeps rows of equal input apart from each other.
_EXPLODED = "kind byte, slot int, block long, ord long, keys array<{key}>, data binary, counts binary, steps binary"
_ENCODED = "kind byte, block long, ord long, keys array<{key}>, data binary, counts binary, steps binary"
FIELDS = ["kind", "slot", "block", "ord", "keys", "data", "counts", "steps"]
TEXTS_IN_ROW = 128


class Block:
    """Texts of one input split, some tens of megabytes, as numbers of their pre-tokens."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.keys: list = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, key, text: str | None, find) -> None:
        number = self.number
        self.keys.append(key)
        self.texts.append(np.fromiter((number.setdefault(w, len(number)) for w in _split(find, text or "")), np.int32))
        self.size += len(text or "")

    def rows(self, block: int, slots: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        often = np.zeros(len(self.number), np.int64)
        for t in self.texts:
            np.add.at(often, t, 1)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for a in range(0, len(self.keys), TEXTS_IN_ROW):
            some = self.texts[a : a + TEXTS_IN_ROW]
            yield _row(0, (block + a) % slots, block, a, self.keys[a : a + TEXTS_IN_ROW], pack(rank[np.concatenate(some)]), pack(np.array([len(t) for t in some])), b"", kind)
        words = [w.encode() for w in self.number]
        to = np.fromiter((zlib.crc32(w) % slots for w in words), np.int64, len(words))[order]
        by = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[by], np.arange(slots + 1)).tolist()
        for s, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            if z > a:
                held = [words[i] for i in order[by[a:z]].tolist()]
                yield _row(1, s, block, -1, [], zstandard.compress(b"".join(held), 3), pack(np.array([*map(len, held)])), pack(np.diff(by[a:z], prepend=0)), kind)


def _row(kind: int, slot: int, block: int, ord_: int, keys: list, data: bytes, counts: bytes, steps: bytes, key: pa.DataType) -> pa.RecordBatch:
    values = [pa.array([kind], pa.int8()), pa.array([slot], pa.int32()), pa.array([block], pa.int64()), pa.array([ord_], pa.int64()), pa.array([keys], pa.list_(key)), *(pa.array([x], pa.binary()) for x in (data, counts, steps))]
    return pa.RecordBatch.from_arrays(values, FIELDS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row: the token ids of the whole text.

    A null or empty text has no ids. Repeated ids and texts stay rows of their own: rows, not ids,
    are put together again. Other columns are left out; an empty table gives an empty one.
    ranks_path must be readable on executors.
    """
    blocks, assemble, key = _encoded(docs, ranks_path, pattern, id_col, text_col)
    return blocks.mapInArrow(lean(assemble), f"key {key}, ids array<int>").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: decode() of encode(), by one worker of a task where each of both takes one of its own."""
    blocks, assemble, key = _encoded(docs, ranks_path, pattern, id_col, text_col)
    back = _decoder(ranks_path)
    return blocks.mapInArrow(lean(lambda batches: back(assemble(batches))), f"key {key}, ids array<int>, decoded binary").withColumnRenamed("key", id_col)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """Texts and ids of their words block by block, what puts them together, and the type of the id."""
    slots = partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key = rows.schema["key"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        block, number, kind = Block(), TaskContext.get().partitionId() << 32, None
        for b in slices(batches, "text", PIECE_BYTES):
            kind = b.column(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(k, t.as_py(), find)
                if block.size >= BLOCK_CHARS:
                    yield from block.rows(number, slots, kind)
                    block, number = Block(), number + 1
        if block.keys:
            yield from block.rows(number, slots, kind)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some slots. A word is encoded where it is first met and remembered for the other blocks."""
        vocab = vocabulary(ranks_path)
        place: dict[bytes, int] = {}
        ids, ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for b in batches:
            data, counts = b.column(5).to_pylist(), b.column(6).to_pylist()
            for i, kind in enumerate(b.column(0).to_pylist()):
                if not kind:
                    continue
                joined, cuts = zstandard.decompress(data[i]), np.cumsum(unpack(counts[i]), dtype=np.int64).tolist()
                words = [joined[a:z] for a, z in zip([0, *cuts], cuts, strict=False)]
                new = [w for w in words if w not in place]
                if new:
                    out, n = vocab.encode(new)
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    ids, ends = np.concatenate([ids, out.astype(np.uint32)]), np.concatenate([ends, ends[-1] + np.cumsum(n)])
                flat, n = take(ids, ends, np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                data[i], counts[i] = pack(flat), pack(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(data, pa.binary()), pa.array(counts, pa.binary()), b.column(7)], [f for f in FIELDS if f != "slot"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks behind each other, a block's words before its texts."""
        block, found, ids, ends = None, [], None, None
        for b in batches:
            for kind, of, keys, data, counts, steps in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)), strict=True):
                if of != block:
                    block, found, ids = of, [], None
                if kind:
                    found.append((np.cumsum(unpack(steps), dtype=np.int64), unpack(data), unpack(counts)))
                    continue
                if ids is None and found:
                    number, flat, n = (np.concatenate(x) for x in zip(*found, strict=True))
                    edges = np.r_[0, np.cumsum(n, dtype=np.int64)]
                    back = np.empty(len(number), np.int64)
                    back[number] = np.arange(len(number))
                    ids, n = take(flat, edges, back)
                    ends, found = np.r_[0, np.cumsum(n, dtype=np.int64)], []
                tokens, each = unpack(data).astype(np.int64), unpack(counts)
                cuts = np.r_[0, np.cumsum(each, dtype=np.int64)].tolist()
                out = [take(ids, ends, tokens[a:z])[0] if z > a else np.zeros(0, np.uint32) for a, z in zip(cuts, cuts[1:], strict=False)]
                yield ids_batch(b.schema.field("keys").type.value_type, keys, out)

    def ids_batch(kind: pa.DataType, keys: list, out: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), lists], ["key", "ids"])

    exploded = rows.mapInArrow(lean(explode), _EXPLODED.format(key=key))
    encoded = exploded.repartition(slots, "slot").mapInArrow(lean(encode_words), _ENCODED.format(key=key))
    blocks = encoded.repartition(slots, "block").sortWithinPartitions("block", F.desc("kind"), "ord")  # the words first
    return blocks, assemble, key


def take(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[ends[i] : ends[i + 1]] for each i in at, behind each other, and their lengths."""
    starts = ends[at]
    n = ends[at + 1] - starts
    total = int(n.sum())
    index = np.arange(total) + np.repeat(starts - (np.cumsum(n) - n), n)
    return flat[index], n


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) of every row: the bytes of its tokens behind each other.

    Joins the table of token bytes, whose size is that of the vocabulary file, by position in each
    task. Null or empty ids give empty bytes; an id that is no token is an error.
    """
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids"))
    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lean(_decoder(ranks_path)), f"key {key}, ids array<int>, decoded binary").withColumnsRenamed({"key": id_col, "ids": ids_col})


def _decoder(ranks_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(ranks_path).token_bytes
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([decoded(table, ids.values) for ids in b.column(1)], pa.binary())], ["key", "ids", "decoded"])

    return join


def decoded(table: pa.Array, ids: pa.Array | None) -> bytes:
    if ids is None or not len(ids):
        return b""
    got = table.take(ids)
    first, last = np.frombuffer(got.buffers()[1], np.int32)[[got.offset, got.offset + len(got)]]
    return got.buffers()[2].to_pybytes()[first:last]
