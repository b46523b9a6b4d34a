"""Files of alignments that are in order of name, merged without a sort.

An input is a file, or a folder of parts that follow each other in order of their names. Probes look up the name at every
`stride` bytes of every file; their names, in order, give the ranges of names that tasks take. A task seeks to
its range in every input and merges the streams batch by batch: no row is shuffled, and a task holds a batch of each input,
however many rows share a name. Order is told by file and place in it, never by how Spark deals files out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from readlake.sources import bam

#: Bytes of all inputs that a task takes, and the most probes that the driver holds.
RANGE, PROBES = 64 << 20, 20_000
READ = 1 << 20


@dataclass(frozen=True)
class Part:
    """A file of an input, by their numbers."""

    input: int
    number: int
    path: str
    size: int


class Disordered(ValueError):
    """An input that isn't in order of name."""


def parts_of(inputs: list[str]) -> list[Part]:
    out = []
    for i, path in enumerate(inputs):
        for k, name in enumerate(bam.files_of(path, ".bam" if path.endswith(".bam") else "")):
            with bam.opened(name) as f:
                out.append(Part(i, k, name, f.size()))
    return out


def lines(part: Part, start: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(names, SAM lines) of the alignments that begin at a byte of a file or after it, batch by batch."""
    with bam.opened(part.path) as f:
        yield from _bam_lines(f, start, part.size) if part.path.endswith(".bam") else _sam_lines(f, start)


def _sam_lines(f, start: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    f.seek(max(0, start - 1))
    rest, skip = b"", start > 0  # a line that begins before belongs to what lies before
    while True:
        data = f.read(READ)
        if not data:
            data, rest, last = rest, b"", True
        else:
            data, last = rest + data, False
            cut = len(data) if last else data.rfind(b"\n") + 1
            data, rest = data[:cut], data[cut:]
        if skip and data:
            data, skip = data[data.find(b"\n") + 1 :] if b"\n" in data else b"", b"\n" not in data
        some = [x for x in data.decode().split("\n") if x and x[0] != "@"]
        if some:
            value = pa.array(some, pa.string())
            yield pa.array([x.partition("\t")[0] for x in some], pa.string()), value
        if last:
            return


def _bam_lines(f, start: int, end: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    names, first = bam.header(f)
    at = first if start <= first[0] else bam.resync(f, start, end, len(names))
    told = pa.array([n for n, _ in names], pa.string())
    if at is not None:
        for data, starts, _ in bam.chunks(f, at, end):
            got = bam.decoded(data, starts)
            yield got["qname"], line_of(got, told)


def line_of(got: dict, names: pa.Array) -> pa.Array:
    """SAM lines of decoded records, tags with their types."""
    def star(values: pa.Array) -> pa.Array:
        return pc.fill_null(values, "*")

    ref, mate = got["ref_id"].to_numpy(), got["mate_id"].to_numpy()
    mates = pc.if_else(pa.array((mate == ref) & (mate >= 0)), "=", bam.named(names, mate))
    number = lambda k: got[k].cast(pa.string())
    fields = [got["qname"], number("flag"), star(bam.named(names, ref)), number("pos"), number("mapq"), star(got["cigar"]), star(mates), number("pnext"), number("tlen"), star(got["seq"]), star(got["qual"])]
    row = got["tag_row"]
    if len(row):
        tags = pc.binary_join_element_wise("\t", pc.binary_join_element_wise(got["tag"], got["tag_kind"], got["tag_value"], ":"), "")
        ends = np.searchsorted(row, np.arange(len(got["qname"]) + 1))
        fields[-1] = pc.binary_join_element_wise(fields[-1], bam.joined(tags, ends, ""), "")
    return pc.binary_join_element_wise(*fields, "\t")


def probes(spark: SparkSession, parts: list[Part], stride: int) -> list[tuple[Part, int, str]]:
    """(file, byte, name of the first alignment that begins there or after it) of every stride, in the order of inputs, files and bytes."""
    places = [(p, at) for p in parts for at in range(0, max(p.size, 1), stride)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [next((names[0].as_py() for names, _ in lines(*places[i]) if len(names)), None) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["id", "name"])

    n = len(places)
    told = spark.range(0, n, 1, min(n, 200)).mapInArrow(look, "id long, name string").collect() if n else []
    return [(*places[r.id], r.name) for r in sorted(told, key=lambda r: r.id) if r.name is not None]


def merged(spark: SparkSession, inputs: list[str], size: int = RANGE) -> DataFrame:
    """(qname, value): the SAM lines of all inputs in byte order of name, equal names by input, then as they stand in it.

    inputs: SAM or BAM, files or folders of parts. Partitions are ranges of names in their order. An input that isn't in order
    is refused: at once if the probes tell it, else by the task that reads it.
    """
    parts = parts_of(inputs)
    total = sum(p.size for p in parts)
    stride = max(1, min(size, max(total // PROBES, size // 4)))
    seen = probes(spark, parts, stride)
    by_input: list[list[tuple[Part, int, str]]] = [[x for x in seen if x[0].input == i] for i in range(len(inputs))]
    for path, some in zip(inputs, by_input, strict=True):
        if any(a[2].encode() > b[2].encode() for a, b in zip(some, some[1:], strict=False)):
            raise Disordered(f"{path} isn't in order of name")
    names = sorted({x[2].encode() for x in seen})
    n = max(1, min(len(names), -(-total // size)))
    lows = [b"", *(names[i * len(names) // n] for i in range(1, n))]
    ranges = [(low, lows[i + 1] if i + 1 < n else None) for i, low in enumerate(lows)]
    files = [[p for p in parts if p.input == i] for i in range(len(inputs))]
    fences = [[x[2].encode() for x in some] for some in by_input]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                low, high = ranges[i]
                streams = []
                for k, some in enumerate(by_input):
                    if some:
                        part, at, _ = some[max(0, bisect_left(fences[k], low) - 1)]
                        streams.append(Stream(inputs[k], files[k], part.number, at, low, high))
                for names, value in interleaved(streams):
                    yield pa.RecordBatch.from_arrays([names, value], ["qname", "value"])

    return spark.range(0, n, 1, n).mapInArrow(take, "qname string, value string")


class Stream:
    """The alignments of an input whose names lie in a range, from a place on that lies before them."""

    def __init__(self, path: str, files: list[Part], number: int, at: int, low: bytes, high: bytes | None):
        self.path, self.names, self.value = path, pa.array([], pa.string()), pa.array([], pa.string())
        self.batches, self.before = self._batches(files, number, at, low, high), b""

    def _batches(self, files: list[Part], number: int, at: int, low: bytes, high: bytes | None) -> Iterator[tuple[pa.Array, pa.Array]]:
        for part in files[number:]:
            for names, value in lines(part, at if part.number == number else 0):
                if pc.any(pc.less(names[1:], names[:-1])).as_py() or names[0].as_py().encode() < self.before:
                    raise Disordered(f"{self.path} isn't in order of name")
                self.before = names[-1].as_py().encode()
                a = 0 if names[0].as_py().encode() >= low else below(names, low)
                z = len(names) if high is None or self.before < high else below(names, high)
                if z > a:
                    yield names[a:z], value[a:z]
                if z < len(names):
                    return

    def there(self) -> bool:
        """Whether a row is left; reads the next batch if it has to."""
        while not len(self.names):
            got = next(self.batches, None)
            if got is None:
                return False
            self.names, self.value = got
        return True

    def take(self, n: int) -> tuple[pa.Array, pa.Array]:
        out = self.names[:n], self.value[:n]
        self.names, self.value = self.names[n:], self.value[n:]
        return out


def below(names: pa.Array, bound: bytes) -> int:
    """How many of sorted names are less than a bound."""
    a, z = 0, len(names)
    while a < z:
        m = (a + z) // 2
        a, z = (m + 1, z) if names[m].as_py().encode() < bound else (a, m)
    return a


def interleaved(streams: list[Stream]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The rows of all streams by name, equal names by stream.

    All rows before the least of the batches' last names are at hand and sorted together; those of that name then follow
    stream by stream, each read on to the name's end.
    """
    while True:
        live = [s for s in streams if s.there()]
        if not live:
            return
        if len(live) == 1:
            yield live[0].take(len(live[0].names))
            continue
        bound = min(s.names[-1].as_py().encode() for s in live)
        some = [(i, s.take(n)) for i, s in enumerate(live) if (n := below(s.names, bound))]
        if some:
            table = pa.table({"name": pa.chunked_array([x[0] for _, x in some]), "value": pa.chunked_array([x[1] for _, x in some]), "at": pa.chunked_array([pa.array([i] * len(x[0])) for i, x in some])})
            table = table.take(pc.sort_indices(table, [("name", "ascending"), ("at", "ascending")])).combine_chunks()  # a stable sort
            yield table.column(0).combine_chunks(), table.column(1).combine_chunks()
        for s in live:
            while s.there() and s.names[0].as_py().encode() == bound:
                yield s.take(below(s.names, bound + b"\0"))
