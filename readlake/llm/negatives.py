"""Hard negatives of labelled vectors by a vector-approximation file (operator 13).

Each dimension is cut into cells, and a row's approximation is the number of its cell in each. Tables of the cells'
middles and half widths give, for every row and anchor, a lower and an upper bound of the inner product. Only rows that may enter
an anchor's list, judged by the bounds of the other rows and by what the list holds already, are scored exactly.

Rows stay where they are read. Anchors are a stated set of queries and go to the tasks in blocks of a fixed size; a task
keeps the first few rows of each anchor's list, and only those are shuffled and ranked. A first pass finds the positives,
whose scores make the windows that a second pass fills with negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.llm.tables import cut, lean
from readlake.operators.sorting import with_row_ids

#: Cells of a dimension: their numbers are bytes.
CELLS = 256
#: Anchors that go to the tasks at once, and how many of them a task holds against a block of rows.
SENT, BLOCK = 8192, 256
ROWS = 4096
LEAST, MOST = -(2**63) + 1, 2**63 - 1
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: float = 256.0, bound: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row whose id is divisible by `every`.

    A component x counts as floor(scale * x); scores are integer inner products; the higher score comes first, of equals the
    smaller id. An anchor's positives are the first rows of its label under other ids; a positive's negatives are the
    first rows of other labels whose score is at most the positive's and at least 0.8 of it. All lists are exact.

    Rows without id, label or vector, or with a component that is null, infinite or no number, take no part. Vectors
    shorter than the longest go on in zeros. Rows that are repeated count each; an anchor that is repeated has its lists
    twice. A score beyond 64 bits counts as the largest such number. Other columns are left out; without rows or anchors
    there is no result. Cells are fitted on about `bound` rows (documented parameter), their outer ends on all.
    """
    vector = F.col(vector_col).cast("array<double>")
    right = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & right)
    cells = fitted(used, scale, bound)
    anchors = with_row_ids(used.where(F.col("id") % every == 0), "id", "label", "v", row_id="n")
    n = anchors.count()
    spark = rows.sparkSession
    found = []
    for a in range(0, n, SENT):
        some = Anchors.of(anchors.where((F.col("n") >= a) & (F.col("n") < a + SENT)).orderBy("n").toArrow(), scale, cells.d, positives)
        some.put(ranked(used.mapInArrow(lean(_search(spark, some, cells, scale, positives)), "list int, score long, id long"), positives).toArrow())
        hits = ranked(used.mapInArrow(lean(_search(spark, some, cells, scale, negatives)), "list int, score long, id long"), negatives)
        names = spark.createDataFrame(some.lists(), "list int, anchor_id long, positive_id long, positive_score long")
        told = hits.join(F.broadcast(names), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.append(cut(told) if n > SENT else told)  # blocks of anchors leave the tasks' memory one after another
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def ranked(hits: DataFrame, most: int) -> DataFrame:
    """(list, score, id, rank): the first rows of each list among those that tasks have kept."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


@dataclass
class Cells:
    """Of each dimension the cells' inner borders, and of each cell its middle and half width."""

    borders: list[np.ndarray]
    middle: np.ndarray
    half: np.ndarray

    @property
    def d(self) -> int:
        return len(self.borders)

    def approximated(self, x: np.ndarray) -> np.ndarray:
        """The number of the cell of each component: a byte each."""
        return np.stack([np.searchsorted(b, x[:, j], "right") for j, b in enumerate(self.borders)], 1).astype(np.uint8) if self.d else np.zeros(x.shape, np.uint8)

    def looked_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(self.d)
        return self.middle[at, codes], self.half[at, codes]


def fitted(used: DataFrame, scale: float, bound: int) -> Cells:
    """Cells with about as many of the sampled rows in each; the outer ones reach to the least and the greatest component of all rows."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.zeros(0), np.zeros(0), 0
        for b in batches:
            x = components(b.column(0), scale)
            if len(x):
                d = max(len(low), x.shape[1])
                x = np.pad(x, ((0, 0), (0, d - x.shape[1])))  # where a vector ends zeros begin
                low, high = (np.pad(e, (0, d - len(e)), constant_values=0.0 if n else fill) for e, fill in ((low, np.inf), (high, -np.inf)))
                low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
        at = np.arange(-1, len(low), dtype=np.int32)  # at -1 the rows alone
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[0.0, low]), pa.array(np.r_[0.0, high]), pa.array(np.full(len(at), n))], ["at", "low", "high", "n"])

    told = used.select("v").mapInArrow(lean(ends), "at int, low double, high double, n long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("at").collect()
    n, told = told[0]["n"] if told else 0, told[1:]
    drawn = used if n <= bound else used.where(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    sample = np.pad(x := components(drawn.select("v").toArrow().column(0).combine_chunks(), scale), ((0, 0), (0, len(told) - x.shape[1])))
    borders, middle, half = [], np.zeros((len(told), CELLS)), np.zeros((len(told), CELLS))
    for j, r in enumerate(told):
        low, high = (min(r["low"], 0.0), max(r["high"], 0.0)) if r["n"] < n else (r["low"], r["high"])
        inner = np.unique(np.quantile(sample[:, j], np.linspace(0, 1, CELLS + 1)[1:-1], method="nearest")) if len(sample) else np.zeros(0)
        inner = inner[inner > low]
        a, z = np.r_[low, inner], np.r_[inner - 1, high]  # components are whole numbers
        borders.append(inner)
        middle[j, : len(a)], half[j, : len(a)] = (a + z) / 2, np.maximum(z - a, 0) / 2
    return Cells(borders, middle, half)


def components(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each vector's components as rows of whole numbers; shorter vectors go on in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    d = int(lengths.max())
    if (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Lists:
    """The first k of each of n lists by score, the higher first, then by id, over all that is put in."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), LEAST, np.int64), np.full((n, k), MOST, np.int64)

    def least(self) -> np.ndarray:
        """What a row must score at least to enter each list."""
        return np.where(self.n == self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        old = np.unique(at)
        row, col = np.nonzero(np.arange(self.k) < self.n[old, None])
        at, score, ids = np.r_[at, old[row]], np.r_[score, self.score[old[row], col]], np.r_[ids, self.id[old[row], col]]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.score[at[first], place[first]], self.id[at[first], place[first]] = score[first], ids[first]
        self.n[old] = np.minimum(self.k, np.searchsorted(at, old, "right") - np.searchsorted(at, old))

    def rows(self) -> pa.RecordBatch:
        at, col = np.nonzero(np.arange(self.k) < self.n[:, None])
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(self.score[at, col]), pa.array(self.id[at, col])], ["list", "score", "id"])


@dataclass
class Anchors:
    """A block of anchors; with positives once they are known: a list of negatives belongs to each."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    k: int
    positive_id: np.ndarray | None = None
    positive_score: np.ndarray | None = None
    known: np.ndarray | None = None

    @classmethod
    def of(cls, table: pa.Table, scale: float, d: int, k: int) -> Anchors:
        x = components(table.column("v").combine_chunks(), scale)
        return cls(table.column("id").to_numpy(), table.column("label").to_numpy(), np.pad(x, ((0, 0), (0, d - x.shape[1]))), k)

    def put(self, hits: pa.Table) -> None:
        at, rank = hits.column("list").to_numpy(), hits.column("rank").to_numpy() - 1
        self.positive_id, self.positive_score = (np.zeros((len(self.id), self.k), np.int64) for _ in range(2))
        self.known = np.zeros((len(self.id), self.k), bool)
        self.positive_id[at, rank], self.positive_score[at, rank], self.known[at, rank] = hits.column("id").to_numpy(), hits.column("score").to_numpy(), True

    def lists(self) -> list[tuple[int, int, int, int]]:
        """(list, anchor_id, positive_id, positive_score) of each list of negatives."""
        return [(int(i * self.k + j), int(self.id[i]), int(self.positive_id[i, j]), int(self.positive_score[i, j])) for i, j in np.argwhere(self.known)]


def _search(spark, anchors: Anchors, cells: Cells, scale: float, k: int):
    """A function of batches of rows (id, label, v): positives of the anchors, or negatives once positives are known."""
    shared = spark.sparkContext.broadcast((anchors, cells))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = shared.value
        lists = Lists(len(some.id) * (1 if some.known is None else some.k), k)
        step = max(1, min(ROWS, (1 << 21) // max(1, held.d)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = components(part.column(2), scale)
                _searched(some, held, np.pad(x, ((0, 0), (0, held.d - x.shape[1]))), part.column(0).to_numpy(), part.column(1).to_numpy(), lists)
        yield lists.rows()

    return search


def _searched(some: Anchors, held: Cells, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, lists: Lists) -> None:
    """Puts a block of rows into the lists."""
    middle, half = held.looked_up(held.approximated(x))
    for a in range(0, len(some.id), BLOCK):
        z = min(a + BLOCK, len(some.id))
        q = some.x[a:z]
        centre = middle @ q.T
        reach = half @ np.abs(q).T + 1e-10 * (np.abs(x).max(initial=0) * np.abs(q).sum(1))  # what floating point may lose
        low, high = (np.clip(bound, LEAST, MOST) for bound in (centre - reach, centre + reach))
        same = labels[:, None] == some.label[a:z]
        if some.known is None:
            may = same & (ids[:, None] != some.id[a:z])
            may &= high >= np.maximum(lists.least()[a:z], _nth(np.where(may, low, -np.inf), lists.k))
            i, j = np.nonzero(may)
            lists.add(j + a, exact(x, q, i, j), ids[i])
            continue
        top = some.positive_score[a:z]
        floor = top - top // 5  # the least whole number of 0.8 of it or more
        may, least = np.zeros(same.shape, bool), lists.least().reshape(-1, some.k)[a:z]
        for s in range(some.k):
            t, f = top[:, s].astype(float), floor[:, s].astype(float)
            within = np.where(~same & (low >= f) & (high <= t), low, -np.inf)
            may |= some.known[a:z, s] & ~same & (low <= t) & (high >= np.maximum(np.maximum(f, least[:, s]), _nth(within, lists.k)))
        i, j = np.nonzero(may)
        score = exact(x, q, i, j)
        for s in range(some.k):
            fits = some.known[a:z, s][j] & (score <= top[j, s]) & (score >= floor[j, s])
            lists.add((j[fits] + a) * some.k + s, score[fits], ids[i[fits]])


def _nth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column; less than any if there are fewer."""
    n = len(values)
    return np.partition(values, n - k, axis=0)[n - k] if n >= k else np.full(values.shape[1], -np.inf)


def exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows i of x with rows j of q, by as wide numbers as they need."""
    out = np.zeros(len(i), np.int64)
    size = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for a in range(0, len(i), step):
        b, c = x[i[a : a + step]], q[j[a : a + step]]
        if size < 2**53:
            out[a : a + step] = np.einsum("ij,ij->i", b, c)
        elif size < 2**62:
            out[a : a + step] = np.einsum("ij,ij->i", b.astype(np.int64), c.astype(np.int64))
        else:
            out[a : a + step] = [min(max(sum(int(u) * int(v) for u, v in zip(r, s, strict=True)), LEAST), MOST) for r, s in zip(b.tolist(), c.tolist(), strict=True)]
    return out
