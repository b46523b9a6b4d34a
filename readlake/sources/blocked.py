"""Text in blocked gzip (rows of gzip members of at most 64 KiB, as BAM has) as a Spark data source whose files are split.

    blocked.pieces(spark, "file:///data/acc2taxid.tsv.gz")  # (value, file, block, i)
    blocked.write(lines, "file:///data/out.fq.gz")  # a folder of parts

Which files are split: those whose first member tells its own size (`is_blocked`), as bgzip and write() make them. An ordinary gzip
file has no place to begin at but its start, so Spark's reader takes each in one task; uncompressed text is split by
Spark's reader. pieces() takes whichever fits and gives the same rows.

A piece is what stands between two separators. A range of bytes finds its first block as the BAM source does, and has the pieces
behind the separators that begin in its blocks; the last of them is read on to its end.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from readlake.sources import bam

#: Bytes of unpacked text that are cut into pieces at once, and of compressed text that a task takes.
READ, SPLIT = 1 << 20, 32 << 20
#: No byte of deflated data tells more than so many; with a range's start it makes numbers that grow along a file.
MOST_RATIO = 1032


class BlockedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocked_text"

    def schema(self) -> str:
        return "value string, file string, block long, i long"

    def reader(self, schema) -> BlockedReader:
        return BlockedReader(self.options["path"], self.options.get("sep", "\n").encode(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> BlockedWriter:
        return BlockedWriter(self.options["path"])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BlockedReader(DataSourceReader):
    def __init__(self, path: str, sep: bytes, split: int):
        self.path, self.sep, self.split = path, sep, split

    def partitions(self) -> list[Range]:
        out = []
        for path in bam.files_of(self.path, ".gz"):
            with bam.opened(path) as f:
                n = f.size()
            out += [Range(path, a, min(a + self.split, n)) for a in range(0, max(n, 1), self.split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with bam.opened(part.path) as f:
            i = 0
            for some in cut(f, part.start, part.end, self.sep):
                values = pa.array([x.decode("utf-8", "replace") for x in some], pa.string())
                n = len(some)
                yield pa.RecordBatch.from_arrays([values, pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(i, i + n), pa.int64())], ["value", "file", "block", "i"])
                i += n


def first_block(f, start: int, end: int) -> int | None:
    """Where the first block of a range begins: its head and the next one's are right and it unpacks."""
    if not start:
        return 0
    f.seek(start)
    data, at = f.read(min(1 << 17, f.size() - start)), -1
    while True:
        at = data.find(bam.MAGIC, at + 1)
        if at < 0 or start + at >= end:
            return None
        if data[at + 12 : at + 14] == b"BC":
            try:
                got = bam.block(f, start + at)
                if got is not None:
                    bam.block(f, got[1])
                    return start + at
            except (ValueError, zlib.error, struct.error):
                continue


def cut(f, start: int, end: int, sep: bytes) -> Iterator[list[bytes]]:
    """Pieces behind the separators that begin in a range's blocks, and that at the file's start, some at a time."""
    place = first_block(f, start, end)
    if place is None:
        return
    data, begun = b"", start == 0
    while place < end:
        some, size = [data], len(data)
        while place < end and size < READ + len(data):
            got = bam.block(f, place)
            if got is None:
                break
            some.append(got[0])
            size, place = size + len(got[0]), got[1]
        data, done = b"".join(some), place < end and got is None
        *found, rest = data.split(sep)
        if found:
            if whole := found if begun else found[1:]:
                yield whole
            data, begun = rest, True
        elif not begun:
            data = data[-(len(sep) - 1) :] if len(sep) > 1 else b""  # what may begin a separator
        if done:
            break
    # beyond the range: to the end of the piece that is open, and of those behind separators that begin before
    inside = len(data)
    while True:
        at = data.find(sep)
        if at >= 0:
            if begun:
                yield [data[:at]]
            if at >= inside:
                return
            data, inside, begun = data[at + len(sep) :], inside - at - len(sep), True
            continue
        if not begun and inside < 1:
            return
        got = bam.block(f, place)
        if got is None:
            if begun and data:
                yield [data]
            return
        data, place = data + got[0], got[1]
        if not begun and len(data) >= inside + len(sep):
            if data.find(sep, 0, inside + len(sep) - 1) < 0:
                return


class BlockedWriter(DataSourceWriter):
    """Rows of one column of lines as files of blocks, one for each task."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = bam.system_of(self.path)
        system.create_dir(at, recursive=True)
        attempt = f"{at}/_attempt-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(attempt, compression=None) as out:
            held = bytearray()
            for r in rows:
                held += r[0].encode() + b"\n"
                while len(held) >= bam.BLOCK:
                    out.write(bam.packed_block(bytes(held[: bam.BLOCK])))
                    del held[: bam.BLOCK]
            if held:
                out.write(bam.packed_block(bytes(held)))
            out.write(bam.EOF_BLOCK)
        return bam.Written(attempt, f"{at}/part-{context.partitionId():05d}.gz")

    def commit(self, messages: list) -> None:
        """Only files of tasks that count get their names; what others left goes."""
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


def write(lines: DataFrame, path: str) -> None:
    """A folder of parts of blocked gzip, each with its partition's lines, a column `value`."""
    lines.sparkSession.dataSource.register(BlockedSource)
    lines.select("value").write.format("blocked_text").option("path", path).mode("append").save()


def is_blocked(path: str) -> bool:
    """Whether a file is blocked gzip, or a folder of nothing else; not, where its store can't be looked into."""
    try:
        for name in bam.files_of(path, ""):
            with bam.opened(name) as f:
                head = f.read(18)
            if head[:4] != bam.MAGIC or head[12:14] != b"BC":
                return False
        return True
    except Exception:  # globs, or stores that only Spark opens: its own reader takes them
        return False


def pieces(spark: SparkSession, path: str, sep: str = "\n", split: int = SPLIT) -> DataFrame:
    """(value, file, block, i) of the pieces of text; within a file they stand in the order of block and i."""
    if is_blocked(path):
        spark.dataSource.register(BlockedSource)
        return spark.read.format("blocked_text").option("sep", sep).option("split", split).load(path)
    return spark.read.option("lineSep", sep).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))


def lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, ord, value) of lines; ord grows along each file."""
    if is_blocked(path):
        return pieces(spark, path, "\n", split).select("file", (F.col("block") * MOST_RATIO + F.col("i")).alias("ord"), "value")
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), "value")
