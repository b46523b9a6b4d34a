"""Conversations as training text, and back (operator 5).

A turn is rendered between control strings and parsed again on the spot; where the parsed turn is
not the source's, its content is escaped and rendered again, until both are identical. The escape
puts one backslash more between `<` and `|`, and the parser takes one away, so it is reversible
for every text, also for one that holds escapes. A turn whose rendering parses to itself
parses so within a conversation too, as the parser stops at the first end mark.

Conversations leave as pieces of about a million characters that end between turns, so one
with very many turns is never held as a whole: rows are sorted by conversation and stream by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.tables import lean, partitions, small_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PIECE = 1 << 20


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end hold the text as it stands, escaped. ValueError off the grammar."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        body = text.index("\n", at) + 1
        end = text.index(END, body)
        at, head = end + len(END) + 1, text[at + len(START) : body - 1]
        if text[at - 1 : at] != "\n":
            raise ValueError(f"no line ends at {at - 1}")
        yield unescape_role(head), unescape(text[body:end]), body, end


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses to itself, and where its text stands in it."""
    for put_role, put in ((str, str), (str, escape), (escape_role, escape)):
        out = f"{START}{put_role(role)}\n{put(text)}{END}\n"
        try:
            found = list(parse(out))
        except ValueError:
            continue
        if [t[:2] for t in found] == [(role, text)]:
            return out, found[0][2], found[0][3]
    raise AssertionError("a turn with all content escaped parses to itself")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, piece, formatted, n_turns, loss) of each piece of each conversation, pieces from 0 on.

    loss: array of (start, end), code points of formatted under the loss mask: the texts of assistant
    turns. Turns go by turn, equal ones by role, then text; a null turn comes first. A null role or text is an
    empty one; a null id is a conversation of its own; repeated rows are turns each; other columns are
    left out; an empty table gives an empty one. Rows of a conversation follow each other in one partition.
    """
    small_batches(turns.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    rows = turns.select(F.col(id_col).alias("key"), F.col(turn_col).alias("turn"), text[0].alias("role"), text[1].alias("text"))
    rows = rows.repartition(partitions(turns.sparkSession), "key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    key = rows.schema["key"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def piece() -> pa.RecordBatch:
            spans = pa.array([[{"start": a, "end": z} for a, z in loss]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([number], pa.int32()), pa.array(["".join(held)]), pa.array([len(held)], pa.int64()), spans], ["key", "piece", "formatted", "n_turns", "loss"])

        now, number, held, loss, size = None, 0, [], [], 0
        for b in batches:
            kind = b.column(0).type
            for of, role, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (of != now or size >= PIECE):
                    yield piece()
                    number, held, loss, size = number + 1 if of == now else 0, [], [], 0
                now = of
                out, a, z = render(role, said)
                if role == LEARNED:
                    loss.append((size + a, size + z))
                held.append(out)
                size += len(out)
        if held:
            yield piece()

    return rows.mapInArrow(lean(pieces), f"key {key}, piece int, formatted string, n_turns long, loss array<struct<start int, end int>>").withColumnRenamed("key", id_col)


def read_back(pieces: DataFrame, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) by parsing what format_conversations gave.

    Digests run on from piece to piece. in_order tells that the pieces of a conversation follow each other in a partition, as they
    leave there; else, as for a table that was written and read, they are dealt and sorted first. Conversations without an id
    are one then.
    """
    rows = pieces.select(F.col(id_col).alias("key"), "piece", "formatted", "loss")
    if not in_order:
        rows = rows.repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "piece")
    key = rows.schema["key"].dataType.simpleString()
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now = None, None

        def told() -> pa.RecordBatch:
            k, n, turns, chars, loss, size = now
            return pa.RecordBatch.from_arrays([pa.array([k], kind), *(pa.array([x]) for x in (n, turns.hexdigest(), chars, loss.hexdigest(), size))], names)

        for b in batches:
            kind = b.column(0).type
            for k, number, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not number:
                    if now:
                        yield told()
                    now = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    learned = unescape(text[s["start"] : s["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
        if now:
            yield told()

    return rows.mapInArrow(lean(read), f"key {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("key", id_col)
