"""Occurrences of benchmark passages in whole texts, by Wu-Manber search over words (operator 4).

A pattern is a window of `width` consecutive words of a benchmark item, or a whole shorter item.
Patterns of one length m are searched together: a table over hashed blocks of two words says how
far the search may jump where a block occurs in no pattern, or how far it stands from a pattern's
end; where it stands at an end, the patterns with that last block are compared word for word. All
texts of a batch are searched in step with each other.

The patterns are a stated query set. A task holds at most `most` of them; more are searched for
block after block, each over all rows, and each block adds to what the blocks before have found, which is written between
them: no stage searches for more than one block. A pattern counts once for each of its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.ragged import LOWER, PIECE_BYTES, Texts, mix, powers, slices, span_hashes
from readlake.llm.tables import cut, dropped, lean, small_batches, stored

#: 0-9, a-z and all bytes of characters beyond ASCII, after A-Z have become a-z.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
WIDTH = 10
MOST_PATTERNS = 100_000


def words_of(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts; starts, ends, text numbers and hashes of their words."""
    texts = Texts(column)
    texts.data = LOWER[texts.data]
    starts, ends, doc = texts.words(IS_WORD)
    return texts, starts, ends, doc, texts.hashes(starts, ends)


def patterns(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(pattern, m, item): each distinct window with its number of words and an item, as a string, that holds it; null for a null one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PIECE_BYTES):
            texts, starts, ends, doc, _ = words_of(b.column(1))
            data, items = texts.data.tobytes(), b.column(0).to_pylist()
            words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            edges = np.searchsorted(doc, np.arange(texts.n + 1)).tolist()
            for item, a, z in zip(items, edges, edges[1:], strict=False):
                m = min(width, z - a)
                found = [b" ".join(words[i : i + m]) for i in range(a, z - m + 1)] if m else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array([f.decode() for f in found]), pa.array([m] * len(found), pa.int32())], ["item", "pattern", "m"])

    return rows.mapInArrow(lean(cut), "item string, pattern string, m int").select("pattern", "m", "item").distinct()


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, found: list[tuple[bytes, list[str]]], m: int):
        self.m, self.block, self.found = m, min(2, m), found
        words = [w for p, _ in found for w in p.split(b" ")]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        joined = np.frombuffer(b"".join(words), np.uint8)
        h = span_hashes(joined, ends - lengths, ends).reshape(-1, m)
        self.bits = np.uint64(64 - max(12, (8 * len(found) * m).bit_length()))
        self.shift = np.full(1 << int(64 - self.bits), m - self.block + 1, np.int64)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self.blocks(h[:, end - 1] if self.block == 2 else None, h[:, end]), m - 1 - end)
        last = self.blocks(h[:, m - 2] if self.block == 2 else None, h[:, m - 1])
        order = np.argsort(last, kind="stable")
        self.last, self.order = last[order], order
        self.whole = self.sums([h[:, i] for i in range(m)])

    def blocks(self, left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(right if left is None else left * np.uint64(3) + right) >> self.bits).astype(np.int64)

    def sums(self, columns: list[np.ndarray]) -> np.ndarray:
        p = powers(self.m + 1)
        with np.errstate(over="ignore"):
            return sum(c * p[i + 1] for i, c in enumerate(columns))

    def search(self, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns may start (word numbers) and which ones; edges: the texts' first words, and the end."""
        at, end = edges[:-1] + self.m - 1, edges[1:]
        going = at < end
        at, end = at[going], end[going]
        stops = []
        while len(at):
            jump = self.shift[self.blocks(h[at - 1] if self.block == 2 else None, h[at])]
            if not jump.all():
                stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(stops)
        block = self.blocks(h[at - 1] if self.block == 2 else None, h[at])
        a, z = np.searchsorted(self.last, block), np.searchsorted(self.last, block, "right")
        n = z - a
        which = self.order[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
        start = np.repeat(at - self.m + 1, n)
        same = self.whole[which] == self.sums([h[start + i] for i in range(self.m)])
        return start[same], which[same]


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = MOST_PATTERNS, with_text: bool = False) -> DataFrame:
    """(id, n_words, runs, items) of every row, with_text the text too; docs are not shuffled.

    runs: array of (start, end) word numbers of maximal stretches inside occurrences; items: the
    sorted ids, as strings, of items with an occurring window. A null or empty text has no words; a null
    or wordless item text has no window, an item with a null id has windows and no name; items with equal windows are all named; repeated rows are
    searched each; other columns are left out; empty tables give empty results or no runs.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key = rows.schema["key"].dataType.simpleString()
    pairs = patterns(benchmark, width, item_col, item_text_col)
    # a pattern with its item is what a block holds; a pattern of very many items is searched for in several blocks
    n_blocks = -(-pairs.count() // most) or 1
    if n_blocks > 1:
        pairs = cut(pairs.withColumn("block", F.pmod(F.xxhash64("pattern", "item"), F.lit(n_blocks))))
    for i in range(n_blocks):
        before = rows
        held = (pairs.where(F.col("block") == i) if n_blocks > 1 else pairs).groupBy("pattern", "m").agg(F.collect_list("item").alias("items")).collect()
        rows = _searched(rows, [(r.pattern.encode(), r.m, list(r["items"])) for r in held], key, i == n_blocks - 1 and not with_text)
        if i < n_blocks - 1:
            rows = stored(rows)
            if i:
                dropped(before)
    return rows.withColumnsRenamed({"key": id_col, "text": text_col})


def _searched(rows: DataFrame, held: list[tuple[bytes, int, list[str]]], key: str, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(held)
    first = len(rows.columns) == 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list] = {}
        for p, m, items in shared.value:
            by_length.setdefault(m, []).append((p, items))
        searchers = [Searcher(found, m) for m, found in by_length.items()]
        for b in slices(batches, "text", PIECE_BYTES):
            texts, starts, ends, doc, h = words_of(b.column(1))
            edges = np.searchsorted(doc, np.arange(texts.n + 1))
            cover = np.zeros(len(h) + 1, np.int64)
            items: dict[int, set[str]] = {}
            if not first:
                for i, (runs, had) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    items[i] = set(had)
                    for r in runs:
                        cover[edges[i] + r["start"]] += 1
                        cover[edges[i] + r["end"]] -= 1
            data = texts.data
            for s in searchers:
                at, which = s.search(h, edges)
                for a, w in zip(at.tolist(), which.tolist(), strict=True):
                    text = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(a, a + s.m))
                    if text == s.found[w][0]:  # the words themselves, not their hashes
                        cover[a] += 1
                        cover[a + s.m] -= 1
                        items.setdefault(int(doc[a]), set()).update(s.found[w][1])
            hit = np.cumsum(cover[:-1]) > 0
            inside = np.flatnonzero(hit)
            new = np.r_[True, (np.diff(inside) > 1) | (doc[inside][1:] != doc[inside][:-1])] if len(inside) else np.zeros(0, bool)
            begin, stop = inside[new], inside[np.r_[new[1:], True]] + 1 if len(inside) else inside
            of = doc[begin] if len(begin) else begin
            run = pa.StructArray.from_arrays([pa.array((begin - edges[of]).astype(np.int32)), pa.array((stop - edges[of]).astype(np.int32))], ["start", "end"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(texts.n + 1)).astype(np.int32)), run)
            named = pa.array([sorted(items.get(i, ())) for i in range(texts.n)], pa.list_(pa.string()))
            out = {"key": b.column(0), "text": b.column(1), "n_words": pa.array(np.diff(edges)), "runs": runs, "items": named}
            if last:
                del out["text"]
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    text = "" if last else "text string, "
    return rows.mapInArrow(lean(find), f"key {key}, {text}n_words long, runs array<struct<start int, end int>>, items array<string>")
