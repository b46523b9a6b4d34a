"""Whole Arrow batches of texts as flat numpy arrays: words, lines, hashes.

A batch's texts lie behind each other in one byte buffer; a word is a (start, end) pair in it and
the number of its text. Hashes are 64-bit polynomials over a fixed byte table, finished by a
mixing step, so that they are equal in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 4 << 20
#: As much where a worker stands beside others of its task: tables of powers are kept as long as slices are.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: every input bit reaches every output bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


_BYTES = stream(1, 256)
_BASE = int(stream(2, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}
#: So many powers are kept.
KEPT = (1 << 22) + (1 << 17)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of the polynomial's base, or of its inverse."""
    held = _tables[base]
    if n > len(held):
        grown = np.full(max(n, min(KEPT, 2 * len(held)), 1 << 12), base, U64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(grown, out=grown)
        if n > KEPT:
            return grown
        held = _tables[base] = grown
    return held[:n]


class Texts:
    """The texts of a batch as one buffer; a null text is an empty one."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        kind = pa.large_binary()
        column = column.cast(pa.large_string() if not pa.types.is_large_binary(column.type) else kind)
        if column.null_count:
            column = column.fill_null("")
        self.n = len(column)
        if not self.n:
            self.data, self.offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of bytes that is_word (256 booleans) marks."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = is_word[self.data]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        if len(cuts):  # two texts that touch without a break between them
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span (start, end): of each byte's number times the base to its place in the span, the sum."""
    lengths = ends - starts
    out = np.zeros(len(starts), U64)
    if not len(starts):
        return out
    if len(data) < KEPT:  # as differences of one running sum over all bytes, brought to the span's own powers
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(_BYTES[data] * powers(len(data) + 1)[:-1], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, _INVERSE)[starts] + lengths.astype(U64))
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    full = lengths > 0
    with np.errstate(over="ignore"):
        values = _BYTES[data[at + np.repeat(starts, lengths)]] * powers(max(1, int(lengths.max())))[at]
        if full.any():
            out[full] = np.add.reduceat(values, firsts[full])
        return mix(out + lengths.astype(U64))


#: Bytes that are not space, tab, line feed, vertical tab, form feed or carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def windows(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width consecutive values of one owner, and where each window starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    p = powers(width + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for i in range(width):
            out += values[i : i + n] * p[i + 1]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(out[at]), at


def starts_of(owner: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of each owner's values among values sorted by owner."""
    return np.searchsorted(owner, np.arange(n + 1))


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about size bytes of the column, a single longer text apart."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        col = batch.column(i)
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
