"""Packed binary sequences: two bits a base, one bit a quality, as a Spark data source whose files are split.

    packed.sequences(spark, "file:///data/a.bin")  # (id, description, seq, qual)
    packed.write(sequences, "file:///data/out.bin", threshold=30)  # a folder of parts

A file begins with 64 bytes: the letter b, the threshold of qualities (0 without any), and as eight-byte numbers from byte 8 on how many
records there are, the letters of all ids, descriptions and sequences, and the most of one. A record is three four-byte
lengths, id and description each with a zero behind it, bases, qualities, and zeros up to a multiple of four. A range of
bytes finds its first record by lengths within the header's maxima and by ids that end where they should, several records that hold
something behind each other: zeros, which empty records and rows of a are, prove nothing. So a range has the records from its first one
that holds something up to the first such one beyond its end. Letters other than a, c, g, t become a; a quality is told as at the threshold or as 0. The format isn't compressed.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from readlake.session import cut
from readlake.sources import bam

HEAD, READ = 64, 1 << 20
#: Records behind each other that prove where one begins.
PROOF = 5
BASES = np.frombuffer(b"acgt", np.uint8)
_EXPANDED = BASES[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3]
_CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate(b"acgt"):
    _CODE[_b] = _CODE[_b - 32] = _i
_FIELDS = ["id", "description", "seq", "qual"]


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_sequences"

    def schema(self) -> str:
        return "id string, description string, seq string, qual string"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], int(self.options.get("split", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], int(self.options["threshold"]), json.loads(self.options["counts"]))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def limits(f) -> tuple[int, tuple[int, int, int]]:
    """The threshold of qualities, and the most letters of an id, a description and a sequence."""
    f.seek(0)
    data = f.read(HEAD)
    if len(data) < HEAD or data[:1] != b"b":
        raise ValueError("not a file of packed sequences")
    return data[1], struct.unpack_from("<7Q", data, 8)[4:]


def span(lengths: tuple[int, int, int], threshold: int) -> int:
    """Bytes of a record."""
    n = lengths[0] + 1 + lengths[1] + 1 + (lengths[2] + 3) // 4 + ((lengths[2] + 7) // 8 if threshold else 0)
    return 12 + 4 * ((n + 3) // 4)


class PackedReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        out = []
        for path in bam.files_of(self.path, ""):
            with bam.opened(path) as f:
                n = f.size()
            out += [Range(path, a, min(a + self.split, n)) for a in range(0, n, self.split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with bam.opened(part.path) as f:
            threshold, most = limits(f)
            size = f.size()
            at = HEAD if part.start <= HEAD else resync(f, part.start, part.end, threshold, most, size)
            done = at is None
            while not done:
                f.seek(at)
                data = f.read(max(READ, span(most, threshold)))
                starts, place = [], 0
                while place + 12 <= len(data):
                    lengths = struct.unpack_from("<3i", data, place)
                    done = at + place >= part.end and any(lengths)
                    n = span(lengths, threshold)
                    if done or place + n > len(data):
                        break
                    starts.append(place)
                    place += n
                if not starts:
                    return
                yield batch(np.frombuffer(data, np.uint8), np.array(starts, np.int64), threshold)
                at += place


def resync(f, start: int, end: int, threshold: int, most: tuple[int, int, int], size: int) -> int | None:
    """Where the first record of a range begins; records begin at multiples of four."""
    at, longest = (start + 3) // 4 * 4, span(most, threshold)
    while at < end:
        f.seek(at)
        data = f.read(READ + (PROOF + 3) * longest)
        words = np.frombuffer(data, "<i4", len(data) // 4)
        n = min(len(words) - 2, READ // 4)
        if n <= 0:
            return None
        a, b, c = (words[k : k + n] for k in range(3))
        for i in np.flatnonzero((a >= 0) & (a <= most[0]) & (b >= 0) & (b <= most[1]) & (c >= 0) & (c <= most[2]) & ((a | b | c) > 0)).tolist():
            if at + 4 * i >= end:
                return None
            if likely(data, 4 * i, at, threshold, most, size):
                return at + 4 * i
        at += 4 * n
    return None


def likely(data: bytes, place: int, at: int, threshold: int, most: tuple[int, int, int], size: int) -> bool:
    """Whether PROOF records that hold something, or all that are left, stand behind each other from a place on."""
    proof = 0
    while proof < PROOF:
        if at + place == size:
            return True
        if place + 12 > len(data):
            return proof > 0
        lengths = struct.unpack_from("<3i", data, place)
        if not all(0 <= x <= m for x, m in zip(lengths, most, strict=True)):
            return False
        text = data[place + 12 : place + 14 + lengths[0] + lengths[1]]
        if len(text) == lengths[0] + lengths[1] + 2 and (text[lengths[0]] or text[-1] or text.count(0) != 2):
            return False
        place += span(lengths, threshold)
        proof += any(lengths)
        if at + place > size:
            return False
    return True


def batch(data: np.ndarray, starts: np.ndarray, threshold: int) -> pa.RecordBatch:
    """Columns of the records that begin at starts."""
    n_id, n_text, n = data[starts[:, None] + np.arange(12)].view("<i4").astype(np.int64).T
    at = starts + 12
    ids, at = bam.strings(*bam.gathered(data, at, n_id), n_id > 0), at + n_id + 1
    told, at = bam.strings(*bam.gathered(data, at, n_text), n_text > 0), at + n_text + 1
    bases, ends = bam.gathered(data, at, (n + 3) // 4)
    seq, at = bam.strings(*bam.gathered(_EXPANDED[bases].ravel(), 4 * ends[:-1], n)), at + (n + 3) // 4
    qual = pa.nulls(len(starts), pa.string())
    if threshold:
        bits, ends = bam.gathered(data, at, (n + 7) // 8)
        high = np.unpackbits(bits, bitorder="little")
        qual = bam.strings(*bam.gathered(33 + threshold * high, 8 * ends[:-1], n))
    return pa.RecordBatch.from_arrays([ids, told, seq, qual], _FIELDS)


class PackedWriter(DataSourceWriter):
    """Rows of sequences as files, one for each task, whose header is known before."""

    def __init__(self, path: str, threshold: int, counts: dict[str, list[int]]):
        self.path, self.threshold, self.counts = path, threshold, counts

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = bam.system_of(self.path)
        system.create_dir(at, recursive=True)
        attempt = f"{at}/_attempt-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(attempt, compression=None) as out:
            out.write(b"b" + bytes([self.threshold]) + bytes(6) + struct.pack("<7Q", *self.counts.get(str(context.partitionId()), [0] * 7)))
            for r in rows:
                out.write(record(*r, self.threshold))
        return bam.Written(attempt, f"{at}/part-{context.partitionId():05d}.bin")

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, at = bam.system_of(self.path)
        for m in messages:
            if m is not None:
                system.move(m.attempt, m.name)
        for info in system.get_file_info(fs.FileSelector(at)):
            if os.path.basename(info.path).startswith("_attempt-"):
                system.delete_file(info.path)

    def abort(self, messages: list) -> None:
        system, _ = bam.system_of(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.attempt)


def record(id_: str | None, text: str | None, seq: str | None, qual: str | None, threshold: int) -> bytes:
    a, b, s = (id_ or "").encode(), (text or "").encode(), _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    four = np.append(s, np.zeros(-len(s) % 4, np.uint8)).reshape(-1, 4)
    body = a + b"\0" + b + b"\0" + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    if threshold:
        q = np.frombuffer((qual or "!" * len(s)).encode(), np.uint8) >= 33 + threshold
        body += np.packbits(q, bitorder="little").tobytes()
    return struct.pack("<3i", len(a), len(b), len(s)) + body + bytes(-len(body) % 4)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)


def sequences(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(id, description, seq, qual) of a file or a folder of parts; an empty id or description is null."""
    register(spark)
    return spark.read.format("packed_sequences").option("split", split).load(path)


def write(rows: DataFrame, path: str, threshold: int = 30) -> None:
    """A folder of parts of sequences (id, description, seq, qual). threshold: 0 leaves qualities out."""
    register(rows.sparkSession)
    rows = cut(rows.select(*_FIELDS))
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in _FIELDS[:3]]
    told = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), *(F.sum(s) for s in sizes), *(F.max(s) for s in sizes)).collect()  # a row for each part
    counts = json.dumps({str(r[0]): [int(x) for x in r[1:]] for r in told})
    rows.write.format("packed_sequences").option("path", path).option("threshold", threshold).option("counts", counts).mode("append").save()
