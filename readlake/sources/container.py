"""Text containers of typed lines by the schema that their own header tells, whatever their line types.

A line is a letter and fields; a header line `~ O S 1 3 DNA` says that S lines begin objects and hold a string of DNA, `~ D I 1 6 STRING` that I
lines belong to the object before them, `~ G S 0` behind an object G that G lines group the S objects after them. objects() gives a row
for each object: its own fields as a struct named like its letter, an array of structs for each letter of its lines, and its group.

    container.objects(spark, path)  # S struct<f0 string>, I array<struct<f0 string>>, ...
    container.write(rows, path, container.head(path))

Files are cut at the lines that begin objects, so ranges of a large file are read apart from each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.sources import bam, blocked

#: Names of field types, and what each is here.
TYPES = {"INT": "bigint", "REAL": "double", "CHAR": "string", "STRING": "string", "DNA": "string", "INT_LIST": "array<bigint>", "REAL_LIST": "array<double>", "STRING_LIST": "array<string>"}
LISTS = {"STRING", "DNA", "INT_LIST", "REAL_LIST", "STRING_LIST"}


@dataclass
class Schema:
    """Field types of each letter, which letters begin objects, which group which, and header lines as they stand."""

    lines: list[str]
    fields: dict[str, list[str]] = field(default_factory=dict)
    objects: list[str] = field(default_factory=list)
    groups: dict[str, str] = field(default_factory=dict)  # group letter: letter of its objects
    stored: dict[str, dict[str, int]] = field(default_factory=dict)  # letter: count, max, total

    def __post_init__(self) -> None:
        last = ""
        for x in self.lines:
            f = x.split(" ")
            if f[0] == "~" and f[1] == "G":
                self.groups[last] = f[2]
            elif f[0] == "~":
                last, n = f[2], int(f[3])
                self.fields[last] = [f[5 + 2 * i] for i in range(n)]
                if any(t not in TYPES for t in self.fields[last]):
                    raise ValueError(f"{x}: a field of an unknown type")
                if f[1] == "O":
                    self.objects.append(last)
            elif f[0] in ("#", "@", "+"):
                self.stored.setdefault(f[1], {})[{"#": "count", "@": "max", "+": "total"}[f[0]]] = int(f[2])

    @property
    def main(self) -> str:
        """The letter of the objects that hold lines: the one that a group groups, else the last one."""
        return next(iter(self.groups.values()), None) or self.objects[-1]

    def parts(self, letter: str) -> list[str]:
        """Letters of the lines that belong to an object: those that the schema tells after it, before the next object."""
        names = list(self.fields)
        at = names.index(letter) + 1
        end = next((i for i in range(at, len(names)) if names[i] in self.objects), len(names))
        return names[at:end]

    def struct(self, letter: str) -> str:
        return "struct<" + ",".join(f"f{i}:{TYPES[t]}" for i, t in enumerate(self.fields[letter])) + ">"


def head(path: str) -> list[str]:
    """The header's lines of a file, or of the first part of a folder."""
    out, rest = [], b""
    with bam.opened(bam.files_of(path, "")[0]) as f:
        while True:
            data = f.read(1 << 16)
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            for x in lines:
                text = x.decode()
                if text[:1].isalpha():
                    return out
                if text:
                    out.append(text)
            if not data:
                return out


def parsed(text: str, types: list[str]) -> dict | None:
    """A line's fields without its letter; strings stand behind their lengths, so they may hold spaces."""
    at, out = 0, {}
    for i, t in enumerate(types):
        if t in ("INT", "REAL", "CHAR"):
            value, at = _word(text, at)
            out[f"f{i}"] = value if t == "CHAR" else int(value) if t == "INT" else float(value)
        elif t in ("STRING", "DNA"):
            out[f"f{i}"], at = _string(text, at)
        else:
            n, at = _word(text, at)
            some = out[f"f{i}"] = []
            for _ in range(int(n)):
                value, at = _string(text, at) if t == "STRING_LIST" else _word(text, at)
                some.append(int(value) if t == "INT_LIST" else float(value) if t == "REAL_LIST" else value)
    return out


def _word(text: str, at: int) -> tuple[str, int]:
    end = text.find(" ", at)
    return (text[at:], len(text)) if end < 0 else (text[at:end], end + 1)


def _string(text: str, at: int) -> tuple[str, int]:
    n, at = _word(text, at)
    return text[at : at + int(n)], at + int(n) + 1


def objects(spark: SparkSession, path: str, letter: str | None = None, split: int = blocked.SPLIT) -> DataFrame:
    """A row for each object of a letter (the schema's main one), in columns named like the letters; `group` if the schema has groups.

    Lines of letters that the header doesn't tell are left out, as are comments.
    """
    schema = Schema(head(path))
    own = letter or schema.main
    inner, group = schema.parts(own), next((g for g, o in schema.groups.items() if o == own), None)
    rows = blocked.pieces(spark, path, f"\n{own} ", split).select("value", "file", "block", "i")
    front, *more = schema.lines  # what stands before a file's first object begins with its header
    first = F.startswith(F.col("value"), F.lit(front + "\n")) & F.contains(F.col("value"), F.lit("\n" + (more or [""])[0]))
    if group:  # a piece's last group line counts for the objects after it; each block needs the last one of the blocks before it
        text = F.concat(F.lit("\n"), "value")
        told = F.when(F.contains(text, F.lit(f"\n{group} ")), F.nullif(F.substring_index(F.substring_index(text, f"\n{group} ", -1), "\n", 1), F.lit("")))
        rows = rows.withColumn("told", told)
        ends = rows.where("told is not null").groupBy("file", "block").agg(F.max_by("told", "i").alias("last"))
        every = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")  # a row for each block
        before = F.last("last", True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        rows = rows.join(F.broadcast(every.select("file", "block", before.alias("before"))), ["file", "block"])  # the rows stay in order
    else:
        rows = rows.withColumns({"told": F.lit(None).cast("string"), "before": F.lit(None).cast("string")})
    rows = rows.select("value", first.alias("first"), "file", "block", "told", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for b in batches:
            out: dict[str, list] = {x: [] for x in (own, *inner, "group")}
            for text, skip, file, block, told, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (file, block):
                    at = file, block
                    now = parsed(before, schema.fields[group]) if before is not None else None
                if not skip:
                    lines = text.split("\n")
                    out[own].append(parsed(lines[0], schema.fields[own]))
                    out["group"].append(now)
                    found: dict[str, list] = {x: [] for x in inner}
                    for x in lines[1:]:
                        if x[:1] in schema.objects:  # another object has begun
                            break
                        if x[:1] in found:
                            found[x[0]].append(parsed(x[2:], schema.fields[x[0]]))
                    for k, v in found.items():
                        out[k].append(v)
                if told is not None:
                    now = parsed(told, schema.fields[group])
            yield pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in out], list(out))

    columns = {own: schema.struct(own)} | {x: f"array<{schema.struct(x)}>" for x in inner} | {"group": schema.struct(group) if group else "string"}
    types = {k: _arrow(v) for k, v in columns.items()}
    df = rows.mapInArrow(read, ", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return df if group else df.drop("group")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def line(letter: str, value: Column, types: list[str]) -> Column:
    """A line of a letter from a struct of its fields."""
    def text(c: Column) -> Column:
        return F.concat_ws(" ", F.length(c).cast("string"), c)

    told = [F.lit(letter)]
    for i, t in enumerate(types):
        v = value[f"f{i}"]
        if t in ("STRING", "DNA"):
            told.append(text(v))
        elif t.endswith("_LIST"):
            items = F.transform(v, text) if t == "STRING_LIST" else v.cast("array<string>")
            told.append(F.concat_ws(" ", F.size(v).cast("string"), F.when(F.size(v) > 0, F.array_join(items, " "))))
        else:
            told.append(v.cast("string"))
    return F.concat_ws(" ", *told)


def write(rows: DataFrame, path: str, lines: list[str], letter: str | None = None) -> None:
    """A folder of parts, each a whole file under the header `lines`; of an object's lines those of a letter stand together, in the schema's order.

    Counts in the header that parts don't have are left out; a group's line stands where its objects begin in a part.
    """
    schema = Schema([x for x in lines if x[0] not in "#@+"])
    own = letter or schema.main
    group = next((g for g, o in schema.groups.items() if o == own), None) if "group" in rows.columns else None

    def lines_of(x: str) -> Column:
        return F.transform(F.coalesce(F.col(f"`{x}`"), F.array().cast(f"array<{schema.struct(x)}>")), lambda v: line(x, v, schema.fields[x]))

    some = [F.array(line(own, F.col(f"`{own}`"), schema.fields[own])), *(lines_of(x) for x in schema.parts(own) if x in rows.columns)]
    of = F.when(F.col("group").isNotNull(), line(group, F.col("group"), schema.fields[group])) if group else F.lit(None).cast("string")
    front = "\n".join(schema.lines)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, begun = None, False
        for b in batches:
            out = []
            for text, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [x for x in (None if begun else front, g if g != before else None, text) if x is not None]
                before, begun = g, True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.select(F.array_join(F.concat(*some), "\n").alias("value"), of.alias("g")).mapInArrow(headed, "value string").write.text(path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(letter, count, max, total) of the lines of each letter: how many, and the longest list and all lists together, in one pass."""
    schema = Schema(head(path))
    size = F.lit(None).cast("bigint")
    for k, types in schema.fields.items():
        at = next((i for i, t in enumerate(types) if t in LISTS), None)
        if at is not None:
            size = F.when(F.col("letter") == k, F.regexp_extract("value", rf"^. (?:\S+ ){{{at}}}([0-9]+)(?: |$)", 1).try_cast("bigint")).otherwise(size)
    lines = blocked.lines(spark, path).select("value", F.substring("value", 1, 1).alias("letter")).where(F.col("letter").rlike("[A-Za-z]") & (F.substring("value", 2, 1) == " ") | F.col("value").rlike("^[A-Za-z]$"))
    return lines.withColumn("size", size).groupBy("letter").agg(F.count(F.lit(1)).alias("count"), F.max("size").alias("max"), F.sum("size").alias("total"))


def validated(spark: SparkSession, path: str) -> DataFrame:
    """(letter, field, actual, stored, state) of counts() against the header's: ok, bad, missing, or unknown for a letter without a definition."""
    schema = Schema(head(path))
    stored = [(k, f, n) for k, some in schema.stored.items() for f, n in some.items()]
    told = spark.createDataFrame(stored, "letter string, field string, stored bigint")
    found = counts(spark, path)
    tall = found.select("letter", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("actual")) for c in ("count", "max", "total")))).alias("x")).select("letter", "x.*").where("actual is not null")
    known = F.col("letter").isin(*schema.fields) if schema.fields else F.lit(True)
    state = F.when(~known, "unknown").when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("actual"), "ok").otherwise("bad")
    return tall.join(told, ["letter", "field"], "left").select("letter", "field", "actual", "stored", state.alias("state"))


def regenerated(spark: SparkSession, path: str) -> list[str]:
    """The header's lines with the counts of what the file holds in the place of those it tells."""
    lines = [x for x in head(path) if x[0] not in "#@+"]
    found = sorted(counts(spark, path).collect(), key=lambda r: r.letter)  # a row for each letter
    own = [f"{sign} {r.letter} {n}" for r in found for sign, n in (("#", r["count"]), ("@", r["max"]), ("+", r.total)) if n]
    at = next((i for i, x in enumerate(lines) if x[0] == "~"), len(lines))
    end = max((i + 1 for i, x in enumerate(lines) if x[0] == "~"), default=at)
    return lines[:end] + own + lines[end:]


def schema_lines(lines: list[str]) -> list[str]:
    """The schema of a header as a schema file tells it."""
    out = []
    for x in lines:
        if x[0] in "12":
            f = x.split(" ")
            out.append(f"{'P' if x[0] == '1' else 'S'} {f[1]} {f[2]}")
        elif x[0] == "~":
            out.append(x[2:])
    return out
