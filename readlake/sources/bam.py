"""BAM as a Spark data source: blocks of a file are read by tasks apart from each other.

    bam.alignments(spark, "file:///data/a.bam")  # a file, or a folder of parts
    bam.headers(spark, "file:///data/a.bam")  # (file, ord, kind, tags)
    bam.write(alignments, "file:///data/out.bam", header_lines)  # a folder of parts

A BAM file is a row of compressed blocks of at most 64 KiB. Each task finds the first block in its range of bytes,
then the first record in it by the fields that a record must have, and reads to the first record past its range.
Fields of all records of some blocks are decoded at once, from one buffer into Arrow columns; only the places of
records are followed one by one. Records name references by number. The names are a table of their own, read once, and joined: no task
holds the header. Parts of a folder that begin with the same blocks have the same header.
Files are opened through pyarrow's file systems, so stores other than local disks do.
"""

from __future__ import annotations

import binascii
import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from readlake.schemas import ALIGNMENTS
from readlake.session import MOST_SENT, cut, sized

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_PAIRS = np.array([BASES[b >> 4] + BASES[b & 15] for b in range(256)]).astype("S2").view(np.uint8).reshape(256, 2)
_DIGITS = bytes.maketrans((BASES + BASES.lower()).encode(), b"0123456789abcdef" * 2)  # two bases make a byte as two hexadecimal digits do
_OTHERS = bytes(c for c in range(256) if chr(c) not in BASES + BASES.lower())
_DIGITS = bytes(ord("f") if c in _OTHERS else _DIGITS[c] for c in range(256))
_SCORES = bytes((c - 33) & 255 for c in range(256))
NUMBERS = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}


#: Schema of records whose references are numbers, -1 for none.
RECORDS = ALIGNMENTS.replace("rname string", "ref_id int").replace("rnext string", "mate_id int")


class BamSource(DataSource):
    """Alignments with names of references, which each task takes from the header: for files with few references."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options["path"], self.options["header"])


class BamRecordSource(DataSource):
    """Alignments with numbers of references."""

    @classmethod
    def name(cls) -> str:
        return "bam_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", 64 << 20)), False)


class BamReferenceSource(DataSource):
    """(ref_id, sn, length) of the references that the binary list of a header names."""

    @classmethod
    def name(cls) -> str:
        return "bam_references"

    def schema(self) -> str:
        return "ref_id int, sn string, length int"

    def reader(self, schema) -> BamReferenceReader:
        return BamReferenceReader(self.options["path"])


class BamHeaderSource(DataSource):
    """The header's lines (file, ord, value) of a BAM file, block after block."""

    @classmethod
    def name(cls) -> str:
        return "bam_header"

    def schema(self) -> str:
        return "file string, ord long, value string"

    def reader(self, schema) -> BamHeaderReader:
        return BamHeaderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (BamSource, BamRecordSource, BamReferenceSource, BamHeaderSource):
        spark.dataSource.register(source)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, tags) of the header's lines, as text.sam_headers gives them; references that only the binary
    list names become @SQ lines behind them."""
    from readlake.sources.text import header_tags

    register(spark)
    return header_tags(spark.read.format("bam_header").load(path))


def alignments(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Alignments (schemas.ALIGNMENTS) of a BAM file or of a folder of them.

    The parts of a folder have one header; of others each is read by its own, and their alignments come together. Names
    of references are joined to the records' numbers: all names, if they are few enough for every task, else those that occur.
    """
    register(spark)
    heads, known = {}, Heads()
    for name in files_of(path):
        with opened(name) as f:
            heads.setdefault(known.of(f)[0], []).append(name)
    read = [_named(spark, ",".join(some), split) for some in heads.values()]
    return reduce(DataFrame.unionByName, read)


def _named(spark: SparkSession, files: str, split: int) -> DataFrame:
    rows = spark.read.format("bam_records").option("split", split).load(files)
    refs = spark.read.format("bam_references").load(files)
    if refs.count() > MOST_SENT:  # of very many references a run hits few
        used = rows.select(F.explode(F.array_distinct(F.array("ref_id", "mate_id"))).alias("ref_id")).distinct()
        refs = cut(refs.join(used, "ref_id", "left_semi"))
    names = sized(refs.select("ref_id", "sn"))
    rows = rows.join(names, "ref_id", "left").withColumnRenamed("sn", "rname")
    mates = names.select(F.col("ref_id").alias("mate_id"), F.col("sn").alias("mate"))
    mate = F.when(F.col("mate_id") < 0, None).when(F.col("mate_id") == F.col("ref_id"), "=").otherwise(F.col("mate"))
    return rows.join(mates, "mate_id", "left").withColumn("rnext", mate).select(*(c.split()[0] for c in ALIGNMENTS.replace("map<string,string>", "map").split(", ")))


def write(alignments: DataFrame, path: str, header: DataFrame) -> None:
    """A folder of parts, each a whole BAM file of its partition's rows under the same header; alignments() reads it back.

    Mandatory fields and tags are written as sinks.sam_lines would tell them.
    """
    from readlake.sources import sinks

    write_lines(sinks.sam_lines(alignments), path, header)


def write_lines(lines: DataFrame, path: str, header: DataFrame) -> None:
    """As write(), of SAM lines in a column `value`.

    header: one column `value`, lines in order, which is written beside the parts first and read there by each task.
    """
    register(lines.sparkSession)
    header.coalesce(1).write.text(path + "/_header")
    lines.write.format("bam").option("path", path).option("header", path + "/_header").mode("append").save()


class Range(InputPartition):
    """Bytes of a file; how many references its header names and where, as (block, place in it), its first record stands."""

    def __init__(self, path: str, start: int, end: int, n_refs: int, first: tuple[int, int]):
        self.path, self.start, self.end, self.n_refs, self.first = path, start, end, n_refs, first


def system_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))


def opened(path: str):
    system, at = system_of(path)
    return system.open_input_file(at)


def files_of(path: str, end: str = ".bam") -> list[str]:
    """Several files, joined by commas; a file itself; of a folder the files with such an end, in order of name."""
    from pyarrow import fs

    if "," in path:
        return path.split(",")
    system, at = system_of(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(os.path.basename(i.path) for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)
    found = [f"{path.rstrip('/')}/{n}" for n in names if n.endswith(end) and not n.startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(f"{path}: no file that ends in {end}")
    return found


class Heads:
    """Headers of files, of which each is read as names once: others are held against the bytes in which it stands."""

    def __init__(self):
        self.known: list[tuple[bytes, int, tuple[int, int]]] = []  # digest, number of references, place of the first record

    def of(self, f) -> tuple[int, int, tuple[int, int]]:
        """Which of the headers seen so far a file has, how many references it names, and where its first record begins."""
        for i, (digest, n_refs, first) in enumerate(self.known):
            if f.size() >= first[0] and beginning(f, first) == digest:
                return i, n_refs, first
        names, first = header(f)
        self.known.append((beginning(f, first), len(names), first))
        return len(self.known) - 1, len(names), first


def beginning(f, first: tuple[int, int]) -> bytes | None:
    """The bytes before the block and the place in it as a digest, None if no block stands there."""
    place, skip = first
    try:
        digest, left = hashlib.sha256(block(f, place)[0][:skip] if skip else b""), place
    except (TypeError, ValueError, zlib.error, struct.error):
        return None
    f.seek(0)
    while left > 0:
        part = f.read(min(left, 1 << 20))
        digest.update(part)
        left -= len(part)
    return digest.digest()


class BamHeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, part) -> Iterator[tuple]:
        path = files_of(self.path)[0]
        with opened(path) as f:
            n, told = 0, set()
            for line in header_lines(f):
                if line.startswith("@SQ"):
                    told.add(next((x[3:] for x in line.split("\t") if x.startswith("SN:")), ""))
                if line:
                    yield path, n, line
                n += 1
            names, _ = header(f)
            for i, (name, length) in enumerate(names):
                if name not in told:
                    yield path, n + i, f"@SQ\tSN:{name}\tLN:{length}"


class BamReferenceReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, part) -> Iterator[tuple]:
        with opened(files_of(self.path)[0]) as f:
            for i, (name, length) in enumerate(header(f)[0]):
                yield i, name, length


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int, named: bool = True):
        self.path, self.split, self.named = path, split, named

    def partitions(self) -> list[Range]:
        out, known = [], Heads()
        for path in files_of(self.path):
            with opened(path) as f:
                n, (_, n_refs, first) = f.size(), known.of(f)
            out += [Range(path, a, min(a + self.split, n), n_refs, first) for a in range(0, n, self.split) if a + self.split > first[0]]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            names = pa.array([n for n, _ in header(f)[0]], pa.string()) if self.named else None
            at = part.first if part.start <= part.first[0] < part.end else resync(f, part.start, part.end, part.n_refs)
            if at is None:
                return
            for data, starts, places in chunks(f, at, part.end):
                yield columns(decoded(data, starts), places, part.path, names)


def block(f, at: int) -> tuple[bytes, int] | None:
    """The text of the block at a byte, and where the next begins; None at the end."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18:
        return None
    if head[:4] != MAGIC or head[12:14] != b"BC":
        raise ValueError(f"no block of a BAM file at {at}")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    body = f.read(size - 18)
    return zlib.decompress(body[:-8], -15), at + size


def unpacked(f) -> Iterator[bytes]:
    """The blocks of a file from its start, without those that hold nothing."""
    at = 0
    while (got := block(f, at)) is not None:
        at = got[1]
        if got[0]:
            yield got[0]


def header_lines(f) -> Iterator[str]:
    """The lines of the header's text; no more than a block and a line are held."""
    blocks = unpacked(f)
    text = b""
    while len(text) < 8:
        text += next(blocks)
    left, text = struct.unpack_from("<i", text, 4)[0], text[8:]
    while True:
        part = text[:left]
        left -= len(part)
        if not left:
            yield from part.rstrip(b"\0").decode().splitlines()
            return
        lines = part.split(b"\n")
        yield from (x.decode() for x in lines[:-1])
        left += len(lines[-1])
        text = lines[-1] + next(blocks)


def header(f) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """Names and lengths of the references, and where, as (block, place in it), the first record begins."""
    text, at, held = bytearray(), 0, []  # offset in text and place of each block

    def need(n: int) -> None:
        nonlocal at
        while len(text) < n:
            got = block(f, at)
            if got is None:
                raise ValueError("the header ends early")
            held.append((len(text), at))
            text.extend(got[0])
            at = got[1]

    need(12)
    if text[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    place = 8 + struct.unpack_from("<i", text, 4)[0]
    need(place + 4)
    n, names = struct.unpack_from("<i", text, place)[0], []
    place += 4
    for _ in range(n):
        need(place + 4)
        size = struct.unpack_from("<i", text, place)[0]
        need(place + 8 + size)
        names.append((text[place + 4 : place + 3 + size].decode(), struct.unpack_from("<i", text, place + 4 + size)[0]))
        place += 8 + size
    if place == len(text):
        return names, (at, 0)
    base, of = max(h for h in held if h[0] <= place)
    return names, (of, place - base)


def likely(text: bytes, at: int, n_refs: int) -> bool:
    """Whether a record may begin there: its fields lie in their ranges and its name ends in a zero."""
    if at + 36 > len(text):
        return False
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", text, at)
    need = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (need <= size < 1 << 26 and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and l_name > 1 and l_seq >= 0):
        return False
    name = text[at + 36 : at + 36 + l_name]
    return len(name) == l_name and name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1])


def possible(text: bytes, at: int, n_refs: int) -> list[int]:
    """Places from at on, a block's worth at most, whose numbers a record may begin with."""
    n = min(1 << 16, len(text) - 36 - at)
    if n <= 0:
        return []
    size, ref, mate = (np.ndarray((n,), "<i4", bytes(text[at : at + n + 36]), k, (1,)) for k in (0, 4, 24))
    return (at + np.flatnonzero((size >= 32) & (size < 1 << 26) & (ref >= -1) & (ref < n_refs) & (mate >= -1) & (mate < n_refs))).tolist()


def resync(f, start: int, end: int, n_refs: int) -> tuple[int, int] | None:
    """The block of a range, and the place in it, of the first record that begins in the range: three likely ones behind each other.

    Blocks are read on until such a record is there, as those at the range's start may lie within a long one.
    """
    f.seek(start)
    data, at = f.read(min(1 << 17, f.size() - start)), -1
    while True:
        at = data.find(MAGIC, at + 1)
        if at < 0 or start + at >= end:
            return None
        if data[at + 12 : at + 14] == b"BC":
            try:
                got = block(f, start + at)
                if got is None:
                    continue
                block(f, got[1])
                break
            except (ValueError, zlib.error, struct.error):
                continue
    text, place, starts = bytearray(got[0]), got[1], [(0, start + at)]

    def holds(n: int) -> bool:
        nonlocal place
        while len(text) < n:
            more = block(f, place)
            if more is None:
                return False
            starts.append((len(text), place))
            text.extend(more[0])
            place = more[1]
        return True

    def confirmed(i: int) -> bool:
        j = i
        for _ in range(3):
            holds(j + 36 + 255)
            if j == len(text):
                return j > i
            if not likely(text, j, n_refs):
                return False
            j += 4 + struct.unpack_from("<i", text, j)[0]
        return holds(j)

    done = 0
    while True:
        holds(done + (1 << 16) + 36)
        for i in possible(text, done, n_refs):
            base, of = max(s for s in starts if s[0] <= i)
            if of >= end:
                return None
            if confirmed(i):
                return of, i - base
        done += min(1 << 16, max(0, len(text) - 36 - done))
        if len(text) - 36 <= done or max(s for s in starts if s[0] <= done)[1] >= end:
            return None


#: Unpacked bytes whose records are decoded together.
CHUNK = 1 << 20


def chunks(f, at: tuple[int, int], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Unpacked bytes, where in them records begin, and the records' numbers, made of block and place; records of blocks before end."""
    place, skip = at
    text, held, want = bytearray(), [], CHUNK  # held: offset in text and place of each block
    while True:
        more = True
        while len(text) < want and more:
            got = block(f, place)
            more = got is not None
            if more:
                held.append((len(text), place))
                text += got[0]
                place = got[1]
        found, n = [], len(text)
        while skip + 4 <= n:
            after = skip + 4 + int.from_bytes(text[skip : skip + 4], "little")
            if after > n:
                break
            found.append(skip)
            skip = after
        starts = np.array(found, np.int64)
        base, of = (np.array(x, np.int64) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
        which = np.searchsorted(base, starts, "right") - 1
        inside = of[which] < end if len(starts) else np.zeros(0, bool)
        if inside.any():
            yield np.frombuffer(bytes(text), np.uint8), starts[inside], of[which][inside] << 16 | (starts - base[which])[inside]
        if not inside.all() or not more or (skip < n and held and of[np.searchsorted(base, skip, "right") - 1] >= end):
            return
        want = max(CHUNK, 2 * (n - skip))
        keep = np.searchsorted(base, skip, "right") - 1 if held else 0
        del text[:skip]
        held = [(int(b) - skip, int(o)) for b, o in zip(base[keep:], of[keep:], strict=True) if b < n]
        skip = 0


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of data behind each other, and where each begins and the last ends."""
    ends = np.r_[0, np.cumsum(lengths)]
    return data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends


def strings(data: np.ndarray, ends: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Stretches of bytes as an Arrow column; null where there is none."""
    out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes()))
    return out if there is None or there.all() else pc.if_else(pa.array(there), out, None)


def joined(values: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """The strings of each stretch as one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), by)


#: Bytes that a value of a type takes.
_WIDTH = np.zeros(256, np.int64)
for _kind, _form in NUMBERS.items():
    _WIDTH[_kind[0]] = struct.calcsize(_form)
_WIDTH[ord("A")] = 1
_OPS = pa.array(list(OPS) + ["?"] * (16 - len(OPS)))


def operations(words: np.ndarray) -> pa.Array:
    """Operations of a CIGAR as text: a number and a letter each."""
    return pc.binary_join_element_wise(pa.array(words >> 4).cast(pa.string()), _OPS.take(pa.array((words & 15).astype(np.int32))), "")


def decoded(data: np.ndarray, starts: np.ndarray) -> dict:
    """Arrow columns of the records that begin at starts, references as numbers; tags as flat columns with their row."""
    size = data[starts[:, None] + np.arange(4)].view("<i4").ravel().astype(np.int64)
    fixed = data[starts[:, None] + np.arange(4, 36)].view("<i4")
    at, end = starts + 36, starts + 4 + size
    l_name, n_ops, l_seq = fixed[:, 2] & 255, fixed[:, 3] & 0xFFFF, fixed[:, 4].astype(np.int64)
    out = {"ref_id": fixed[:, 0], "pos": fixed[:, 1].astype(np.int64) + 1, "mapq": fixed[:, 2] >> 8 & 255, "flag": fixed[:, 3] >> 16 & 0xFFFF, "mate_id": fixed[:, 5], "pnext": fixed[:, 6].astype(np.int64) + 1, "tlen": fixed[:, 7].astype(np.int64)}
    out = {k: pa.array(v) for k, v in out.items()}
    out["qname"] = strings(*gathered(data, at, l_name - 1))
    at = at + l_name
    words, ends = gathered(data, at, 4 * n_ops.astype(np.int64))
    cigar = joined(operations(words.view("<u4")), ends // 4, "")
    out["cigar"] = pc.if_else(pa.array(n_ops > 0), cigar, None)
    at = at + 4 * n_ops
    packed, ends = gathered(data, at, (l_seq + 1) // 2)
    out["seq"] = strings(*gathered(_PAIRS[packed].ravel(), 2 * ends[:-1], l_seq), l_seq > 0)
    at = at + (l_seq + 1) // 2
    scores, ends = gathered(data, at, l_seq)
    known = l_seq > 0
    known[known] = scores[ends[:-1][known]] != 255
    out["qual"] = strings(np.where(scores > 93, 0, scores) + 33, ends, known)
    out["tag_row"], out["tag"], out["tag_kind"], out["tag_value"] = tags(data, at + l_seq, end)
    return out


def tags(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Rows, names, types (those of SAM) and values of all tags, in the order of rows: the first tag of every row, then the second."""
    at, zeros = at.copy(), np.flatnonzero(data == 0)
    live, found = np.flatnonzero(at < end), []
    while len(live):
        c = at[live]
        kind, value = data[c + 2], c + 3
        width = _WIDTH[kind].copy()
        text = (kind == ord("Z")) | (kind == ord("H"))
        width[text] = zeros[np.searchsorted(zeros, value[text])] - value[text] + 1
        many = kind == ord("B")
        width[many] = 5 + data[value[many, None] + np.arange(1, 5)].view("<i4").ravel() * _WIDTH[data[value[many]]]
        if not width.all():
            raise ValueError(f"a tag of the unknown kind {chr(kind[width == 0][0])!r}")
        found.append((live, c, kind, value, width))
        at[live] = value + width
        live = live[at[live] < end[live]]
    if not found:
        return np.zeros(0, np.int64), *(pa.array([], pa.string()) for _ in range(3))
    row, c, kind, value, width = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, c, kind, value, width = (x[order] for x in (row, c, kind, value, width))
    told = np.where(_WIDTH[kind] > 0, np.where(kind == ord("A"), ord("A"), np.where(kind == ord("f"), ord("f"), ord("i"))), kind).astype(np.uint8)
    ones = np.arange(len(row) + 1)
    return row, strings(data[c[:, None] + np.arange(2)].ravel(), 2 * ones), strings(told, ones), _values(data, kind, value, width)


def _values(data: np.ndarray, kind: np.ndarray, value: np.ndarray, width: np.ndarray) -> pa.Array:
    """Values of tags as text, type by type."""
    parts, places = [], []
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        places.append(at)
        if bytes([k]) in NUMBERS:
            parts.append(pa.array(gathered(data, value[at], width[at])[0].view(NUMBERS[bytes([k])])).cast(pa.string()))
        elif k == ord("B"):
            subs = data[value[at]]
            at_sub = [np.flatnonzero(subs == s) for s in np.unique(subs)]
            lists = []
            for some in at_sub:
                form = NUMBERS[bytes([subs[some[0]]])]
                flat, ends = gathered(data, value[at][some] + 5, width[at][some] - 5)
                listed = joined(pa.array(flat.view(form)).cast(pa.string()), ends // struct.calcsize(form), ",")
                lists.append(pc.binary_join_element_wise(pa.scalar(chr(subs[some[0]])), listed, ","))
            parts.append(pa.concat_arrays(lists).take(pa.array(np.argsort(np.concatenate(at_sub), kind="stable"))))
        else:
            parts.append(strings(*gathered(data, value[at], width[at] - (k != ord("A")))))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))


def columns(got: dict, places: np.ndarray, path: str, names: pa.Array | None) -> pa.RecordBatch:
    """A batch of ALIGNMENTS of decoded records, or of RECORDS without names of references."""
    n, row, tag, value = len(places), got["tag_row"], got["tag"], got["tag_value"]
    score = np.full(n, -1, np.int64)
    whole = pc.and_(pc.equal(tag, "AS"), pc.equal(got["tag_kind"], "i")).to_numpy(zero_copy_only=False)
    scores = value.filter(pa.array(whole)).cast(pa.int64())
    score[row[whole]] = np.arange(len(scores))
    md = np.full(n, -1, np.int64)
    is_md = pc.equal(tag, "MD").to_numpy(zero_copy_only=False)
    md[row[is_md]] = np.arange(is_md.sum())
    pick = lambda values, at: values.take(pa.array(np.where(at < 0, 0, at), mask=at < 0)) if len(values) else pa.nulls(n, values.type)
    cigar = got["cigar"]
    long = pc.and_(pc.equal(tag, "CG"), pc.starts_with(value, "I,")).to_numpy(zero_copy_only=False)
    if long.any():  # more operations than a record's own field holds
        told = dict(zip(row[long].tolist(), value.filter(pa.array(long)).to_pylist(), strict=True))
        cigar = pa.array(["".join(operations(np.array(told[i][2:].split(","), np.uint32)).to_pylist()) if i in told else c for i, c in enumerate(cigar.to_pylist())], pa.string())
        keep = pa.array(~long)
        row, tag, value = row[~long], tag.filter(keep), value.filter(keep)
    aux = pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), tag, value)
    out = {k: got[k] for k in ("qname", "flag", "ref_id", "pos", "mapq", "mate_id", "pnext", "tlen", "seq", "qual")}
    out |= {"cigar": cigar, "score": pick(scores, score).cast(pa.int32()), "md": pick(value.filter(pc.equal(tag, "MD")), md), "aux": aux, "file": pa.array([path] * n), "ord": pa.array(places)}
    if names is not None:
        ref, mate = got["ref_id"].to_numpy(), got["mate_id"].to_numpy()
        out["rname"] = named(names, ref)
        out["rnext"] = pc.if_else(pa.array((mate == ref) & (mate >= 0)), "=", named(names, mate))
    fields = [c.split()[0] for c in (RECORDS if names is None else ALIGNMENTS).replace("map<string,string>", "map").split(", ")]
    return pa.RecordBatch.from_arrays([out[f] for f in fields], fields)


def named(names: pa.Array, at: np.ndarray) -> pa.Array:
    """Names of references by number, null for -1."""
    return names.take(pa.array(np.maximum(at, 0), mask=at < 0)) if len(names) else pa.nulls(len(at), pa.string())


class BamWriter(DataSourceArrowWriter):
    """Batches of one column of SAM lines as BAM files, one for each task."""

    def __init__(self, path: str, header: str):
        self.path, self.header = path, header

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = system_of(self.path)
        name = f"{at}/part-{context.partitionId():05d}"
        attempt = f"{at}/_attempt-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(attempt) as out:
            names = self._head(out)
            held = bytearray()
            for b in batches:
                for line in b.column(0).to_pylist():
                    held += packed_record(line.split("\t"), names)
                    while len(held) >= BLOCK:
                        out.write(packed_block(bytes(held[:BLOCK])))
                        del held[:BLOCK]
            if held:
                out.write(packed_block(bytes(held)))
            out.write(EOF_BLOCK)
        return Written(attempt, name + ".bam")

    def _head(self, out) -> dict[str, int]:
        """Writes the header; numbers of the references."""
        from pyarrow import fs

        system, at = system_of(self.header)
        text, named = bytearray(), []
        for info in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda i: i.path):
            if not os.path.basename(info.path).startswith(("_", ".")):
                with system.open_input_stream(info.path) as f:
                    text += f.read()
        for line in text.decode().splitlines():
            if line.startswith("@SQ"):
                tags = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
                named.append((tags.get("SN", "*"), int(tags.get("LN", 0))))
        head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(named))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in named)
        for i in range(0, len(head), BLOCK):
            out.write(packed_block(head[i : i + BLOCK]))
        return {n: i for i, (n, _) in enumerate(named)}

    def commit(self, messages: list) -> None:
        """Only files of tasks that count get their names; what others left goes."""
        from pyarrow import fs

        system, at = system_of(self.path)
        for m in messages:
            if m is not None:
                system.move(m.attempt, m.name)
        for info in system.get_file_info(fs.FileSelector(at)):
            if os.path.basename(info.path).startswith("_attempt-"):
                system.delete_file(info.path)

    def abort(self, messages: list) -> None:
        system, _ = system_of(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.attempt)


class Written(WriterCommitMessage):
    def __init__(self, attempt: str, name: str):
        self.attempt, self.name = attempt, name


#: Bytes that one block of a file holds.
BLOCK = 0xFF00


def packed_block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) + 26 > 1 << 16:  # data that don't compress are stored
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(start: int, end: int) -> int:
    """The number of the smallest bin of the format's index that holds the places from start to end, from 0."""
    end -= 1
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def _cigar(text: str) -> tuple[list[tuple[int, int]], int]:
    """Operations, and how many bases of the reference they span."""
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", text)] if text != "*" else []
    return ops, sum(k for k, o in ops if OPS[o] in "MDN=X") or 1


#: Letters below which a CIGAR or a tag is kept when it has been packed, as many recur.
SHORT = 64


@lru_cache(4096)
def _short_cigar(text: str) -> tuple[list[tuple[int, int]], int]:
    return _cigar(text)


@lru_cache(4096)
def _short_tag(text: str) -> bytes:
    return packed_tag(text)


def packed_record(f: list[str], names: dict[str, int]) -> bytes:
    """A SAM line's fields as a record."""
    name, cigar, seq, qual = f[0].encode() + b"\0", f[5], f[9], f[10]
    ops, span = _short_cigar(cigar) if len(cigar) < SHORT else _cigar(cigar)
    pos, mate_pos = int(f[3]) - 1, int(f[7]) - 1
    ref = names.get(f[2], -1)
    mate = ref if f[6] == "=" else names.get(f[6], -1)
    n = 0 if seq == "*" else len(seq)
    packed = binascii.unhexlify(seq.encode().translate(_DIGITS) + b"0" * (n % 2)) if n else b""
    scores = b"\xff" * n if qual == "*" or len(qual) != n else qual.encode().translate(_SCORES)
    aux = b"".join([_short_tag(x) if len(x) < SHORT else packed_tag(x) for x in f[11:]])
    told = ops
    if len(ops) > 0xFFFF:  # more than the field holds: they stand in a tag, and two operations in their place
        aux += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *(k << 4 | o for k, o in ops))
        told = [(n, OPS.index("S")), (span, OPS.index("N"))]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), int(f[4]), bin_of(max(pos, 0), max(pos, 0) + span) & 0xFFFF, len(told), int(f[1]), n, mate, mate_pos, int(f[8]))
    body += name + struct.pack(f"<{len(told)}I", *(k << 4 | o for k, o in told)) + packed + scores + aux
    return struct.pack("<i", len(body)) + body


def packed_tag(text: str) -> bytes:
    """`XX:T:value` as a tag; whole numbers in the smallest type that holds them."""
    tag, kind, value = text[:2].encode(), text[3:4], text[5:]
    if kind == "i":
        n = int(value)
        for code, low, high in (("c", -(1 << 7), 1 << 7), ("C", 0, 1 << 8), ("s", -(1 << 15), 1 << 15), ("S", 0, 1 << 16), ("i", -(1 << 31), 1 << 31), ("I", 0, 1 << 32)):
            if low <= n < high:
                return tag + code.encode() + struct.pack(NUMBERS[code.encode()], n)
        raise ValueError(f"{text}: beyond 32 bits")
    if kind == "f":
        return tag + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return tag + b"A" + value.encode()[:1]
    if kind == "B":
        form, *some = value.split(",")
        code = NUMBERS[form.encode()][1]
        return tag + b"B" + form.encode() + struct.pack(f"<i{len(some)}{code}", len(some), *(float(x) if form == "f" else int(x) for x in some))
    return tag + (b"H" if kind == "H" else b"Z") + value.encode() + b"\0"
