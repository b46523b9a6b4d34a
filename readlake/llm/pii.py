"""Personal data in whole texts, with SQL functions alone (operator 8).

Regular expressions propose spans; checksums (Luhn for card numbers, mod-97 for account numbers),
value ranges and digit counts confirm them; words nearby adjust the score. A span's place follows
from the lengths of the matches and of the pieces between them, so nothing leaves the JVM.

The expressions are written so that they take linear time: runs are possessive, and a match
starts inside a run of its own characters only where the match before has ended. Places are running sums by doubling, and
stretches of a text are taken from pieces of a fixed size, so a text of very many matches takes hardly more than their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind, expression, what a text must contain for the expression to be tried.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # 13 digits or more; the shorter runs that the full rule would match fail on their count
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
_KEY = r"password|passwd|secret|token|api[_-]?key|access[_-]?key"
SECRET = rf"(?<=(?i:{_KEY})[\x22']?[ ]{{0,2}}[=:][ ]{{0,2}}[\x22']?)[A-Za-z0-9+/_.=-]{{12,}}+"
#: Kinds in the order in which they are told; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "card_short")
BASE = KINDS[:4]
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|server|host", "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer", "secret": _KEY, "card_short": "card|visa|master|amex|credit|debit|pay",
}
#: Score without and with a context word. An added span needs THRESHOLD; base spans stay.
SCORES = {"email": (0.9, 1.0), "ip": (0.8, 1.0), "card": (0.9, 1.0), "phone": (0.7, 1.0), "iban": (0.8, 1.0), "secret": (0.3, 0.8), "card_short": (0.3, 0.8)}
THRESHOLD = 0.5
NEAR = 48

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 modulo 97, its first four characters put last."""
    s = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "card_short":
        return F.length(digits(m)).between(13, 15) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)
    return F.lit(True)


_RULES = {  # expression, whether a text may hold a match, kinds that its matches may be
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), ("email",)),
    "ip": (IP, lambda t: F.contains(t, F.lit(".")), ("ip",)),
    "card": (CARD, lambda t: F.lit(True), ("card", "card_short")),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), ("phone",)),
    "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}"), ("iban",)),
    "secret": (SECRET, lambda t: t.rlike(f"(?i)(?:{_KEY})[\\x22']?[ ]{{0,2}}[=:]"), ("secret",)),
}
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with a column of spans: array of (kind, start, end, score), ordered by kind (KINDS), then start.

    Places are code points, ends exclusive. A null or empty text has an empty array. Rows, their order
    and all other columns stay, but a column named like `into` is replaced; no shuffle, no Python.
    """
    own = [c for c in docs.columns if c.lower() != into.lower()]
    text = F.coalesce(F.col("`_pii_in`.`text`"), F.lit(""))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_pii_row"), F.struct(F.col(f"`{text_col}`").alias("text")).alias("_pii_in"))
    df = df.select("_pii_row", text.alias("_pii_text"))
    t, none = F.col("_pii_text"), F.array().cast("array<string>")
    # one projection after another, each reading what the one before has worked out
    df = df.select("*", *(F.when(may(t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"_hits_{k}") for k, (p, may, _) in _RULES.items()))
    some = reduce(lambda a, b: a | b, (F.size(f"_hits_{k}") > 0 for k in _RULES))
    df = df.select("*", F.when(some, chunks(t)).otherwise(none).alias("_chunks"), *(F.when(F.size(f"_hits_{k}") > 0, F.transform(F.split(t, p, -1), F.length)).otherwise(F.array().cast("array<int>")).alias(f"_gaps_{k}") for k, (p, _, _) in _RULES.items()))
    df = df.select("*", *(_placed(F.col(f"_hits_{k}"), F.col(f"_gaps_{k}")).alias(f"_at_{k}") for k in _RULES))
    found = {kind: _scored(kind, F.col(f"_at_{k}"), F.col("_chunks")) for k, (_, _, kinds) in _RULES.items() for kind in kinds}
    return df.select("_pii_row", F.concat(*(found[k] for k in KINDS)).alias(into)).select(*(F.col(f"_pii_row.`{c}`") for c in own), into)


#: Code points of a piece that a text is cut into, so that a stretch of it is read without what lies before.
CHUNK = 512


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, end exclusive, of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.array_join(F.slice(cut, first + 1, F.greatest(F.floor(end / CHUNK).cast("int") - first + 1, F.lit(0))), "")
    return F.substring(some, start - first * CHUNK + 1, end - start)


def scanned(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Of each place of an array of numbers the sum (by add) of all up to it. Each round doubles how far a place sees, so the
    work is the array's length times its logarithm, where a fold that appends copies what it has at each place."""
    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, add(x, F.get(acc, i - back))).otherwise(x))

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))))
    return F.aggregate(rounds, values, step)


def _placed(hits: Column, gaps: Column) -> Column:
    """(match, start) of each match: the pieces before it and the matches before it lie in front."""
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + F.length(h))
    starts = F.zip_with(scanned(both, lambda x, y: x + y), hits, lambda end, h: end - F.length(h))
    return F.when(F.size(hits) > 0, F.arrays_zip(hits.alias("match"), starts.alias("start"))).otherwise(F.array().cast("array<struct<match:string,start:int>>"))


def _scored(kind: str, placed: Column, cut: Column) -> Column:
    plain, near = SCORES[kind]

    def span(x: Column) -> Column:
        start = x["start"]
        end = start + F.length(x["match"])
        around = between(cut, F.greatest(start - NEAR, F.lit(0)), end + NEAR)
        if kind == "secret":  # its expression asks for a key word right before it, which may stand behind a letter or `_`
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.lit(near).alias("score"))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.when(around.rlike(rf"(?i)\b(?:{CONTEXT[kind]})"), near).otherwise(plain).alias("score"))

    spans = F.transform(F.filter(placed, lambda x: confirmed(kind, x["match"])), span)
    spans = spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(placed) > 0, spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in angle brackets; spans that overlap become one, of the first's kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(cut: Column, held: Column) -> Column:
        """A span that begins inside the ones before only makes them longer: the text between goes on after them."""
        told = F.filter(F.arrays_zip(held["spans"].alias("s"), held["ends"].alias("z"), F.concat(F.array(F.lit(0)), held["ends"]).alias("a")), lambda x: x["s"].isNotNull() & (x["s"]["start"] >= x["a"]))
        pieces = F.transform(told, lambda x: F.concat(between(cut, x["a"], x["s"]["start"]), F.lit("<"), F.upper(x["s"]["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), between(cut, F.get(held["ends"], F.size(held["ends"]) - 1), F.length(text)))

    ends = scanned(F.transform(order, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    # worked out once, as the only element of arrays that are transformed
    whole = F.transform(F.array(F.struct(order.alias("spans"), ends.alias("ends"))), lambda held: F.get(F.transform(F.array(chunks(text)), lambda cut: put(cut, held)), F.lit(0)))
    return F.when(F.size(spans) > 0, F.get(whole, F.lit(0))).otherwise(text)


def counts(spans: Column) -> list[Column]:
    return [F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE]
