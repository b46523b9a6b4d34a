"""Passages of 50 words or more that other documents repeat, wholly or nearly (operator 9).

A text is the sequence of its five-word shingles. Under a hash function the nodes (left, centre, right) of its Cartesian
tree that span at least as many shingles as a passage has are its compact windows: all passages between left and right
that hold the centre share a min-hash, the centre's. Two functions make a family; where windows of both overlap (an
interval join within the text), passages share both min-hashes, which together are the signature. Passages of a
similarity s share that of one of FAMILIES families with a probability of 1 - (1 - s^2)^FAMILIES: 0.98 at 0.8, 1 for equal ones.

Texts that share signatures are compared with that leader of their signatures with which they share most: equal passages by the hash of the whole passage, near ones by their Jaccard similarity, worked out for all
passages of both texts. Passages in shared windows that are not confirmed in this way are held against all others by the
hash of the whole passage, so no exact repeat depends on whom a text was compared with. What is then still open is compared
with the windows of all texts that share a signature with it: windows of equal content once, popular signatures in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.jaccard import MOST_HELD, NEED, OF, WIDTH, pack_keys, packed, pairs_of_blocks, shared, texts_of, together, unpack_keys
from readlake.llm.ragged import LOWER, NOT_SPACE, U64, Texts, mix, powers, slices, stream, windows
from readlake.llm.tables import cut, dealt, dropped, lean, partitions, slots_of, small_batches, stored, swept

WORDS = 50
#: Pairs of functions; passages are candidates where both of a pair agree.
FAMILIES = 4
_SEEDS = stream(9, 16)
_INVERSE = pow(int(powers(2)[1]), -1, 1 << 64)
#: Windows of one signature up to which a task holds them at once, of some 60 shingles each; more are dealt into blocks.
BLOCK = 1 << 14
#: A passage that is not yet confirmed: its hash, the text, where it starts.
OPEN = np.dtype([("h", np.uint64), ("tid", np.int64), ("at", np.int32)])
#: A window that a text shares: its group, and the first and the last start of its passages.
WINDOW = np.dtype([("g", np.uint64), ("first", np.int32), ("last", np.int32)])
SPAN = "array<struct<start int, end int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of 32 bits of each text in order and their n + 1 offsets; words and an id of the words' sequence."""
    texts = Texts(column)
    texts.data = LOWER[texts.data]
    starts, ends, doc = texts.words(NOT_SPACE)
    words = texts.hashes(starts, ends)
    values, at = windows(words, doc, WIDTH)
    edges = np.searchsorted(doc[at] if len(at) else at, np.arange(texts.n + 1))
    n = np.bincount(doc, minlength=texts.n)
    first = np.cumsum(n) - n
    place = (np.arange(len(words)) - np.repeat(first, n)).astype(U64)
    with np.errstate(over="ignore"):
        sums = np.r_[U64(0), np.cumsum(mix(words + place * _SEEDS[12]), dtype=U64)]
        tid = mix(sums[first + n] - sums[first] + n.astype(U64))
    return (values >> U64(32)).astype(np.uint32), edges, n, tid.view(np.int64)


def sliding_minima(values: np.ndarray, t: int) -> np.ndarray:
    """The minimum of each t consecutive values."""
    n = len(values)
    padded = np.full(-(-n // t) * t, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - t + 1], ahead[t - 1 : n])


def starts_of(edges: np.ndarray, t: int) -> np.ndarray:
    """Where passages of t values start."""
    n = np.maximum(np.diff(edges) - t + 1, 0)
    return np.arange(int(n.sum())) + np.repeat(edges[:-1] - (np.cumsum(n) - n), n)


def compact_windows(values: np.ndarray, start: np.ndarray, t: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the Cartesian trees' nodes that span t values or more, and the values' hashes.

    start: where passages begin, as starts_of tells. A node is the least value of all passages between left and right that hold the
    centre; both ends are given as far as passages of t values reach. Of equal values the first is the least.
    """
    h = mix(values ^ seed)
    if not len(start):
        return start, start, start, h
    least = sliding_minima(h & ~U64(0xFFFFFFFF) | np.arange(len(h), dtype=U64), t)[start]
    root = least.astype(np.uint32)  # of each passage's tree
    new = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    return start[new], root[new].astype(np.int64), start[np.r_[new[1:] - 1, len(start) - 1]] + t - 1, h


def signed_windows(values: np.ndarray, edges: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, text, signature) under each family: passages that start from first to last share the signature."""
    out, start, values = [], starts_of(edges, t), values.astype(U64)
    for k in range(FAMILIES):
        of = []
        for seed in _SEEDS[2 * k : 2 * k + 2]:
            left, centre, right, h = compact_windows(values, start, t, seed)
            of.append((left, right - t + 1, h[centre], centre))
        (f1, l1, v1, centre), (f2, l2, v2, _) = of
        if not len(f1):
            continue
        first = np.union1d(f1, f2)
        i, j = np.searchsorted(f1, first, "right") - 1, np.searchsorted(f2, first, "right") - 1
        key = mix(v1[i] ^ mix(v2[j] ^ U64(k)))
        out.append((first, np.minimum(l1[i], l2[j]), np.searchsorted(edges, centre[i], "right") - 1, key))
    if not out:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def low(keys: np.ndarray) -> np.ndarray:
    """What pack_keys keeps of a key beside its slot."""
    return keys & U64((1 << 40) - 1)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys >> U64(40)) % U64(slots)


def number_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The numbers that groups of these signatures have."""
    return low(keys) | slot_of(keys, slots) << U64(40)


def _runs(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal stretches of words that passages starting there cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(starts) > length])
    return [{"start": int(a), "end": int(z) + length} for a, z in zip(starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], strict=True)]


def _passage_hashes(values: np.ndarray, t: int) -> np.ndarray:
    """A hash of each t consecutive values: differences of a running polynomial, brought to one power."""
    n = len(values) - t + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(mix(values.astype(U64) + U64(1)) * p[:-1], out=sums[1:])
        back = np.full(n, _INVERSE, U64)
        back[0] = 1
        return mix((sums[t:] - sums[:-t]) * np.multiply.accumulate(back))


def _counted(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place how many of the places at count for the passage that begins there: those count from first to themselves."""
    return np.cumsum(np.bincount(first[at], minlength=len(first) + 1) - np.bincount(at + 1, minlength=len(first) + 1))[:-1]


class Sequence:
    """Values of a text and what comparisons of its passages of t values need."""

    def __init__(self, values: np.ndarray, t: int):
        self.values, self.t = values, t
        self.order = np.argsort(values, kind="stable")
        sorted_ = values[self.order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        at = np.flatnonzero(new)
        #: the different values in order, where each begins among the sorted ones, and how often it is there
        self.uniq, self.begin, self.many = sorted_[at], at, np.diff(np.r_[at, len(values)])
        #: for each place the number of its value
        self.rank = np.empty(len(values), np.int64)
        self.rank[self.order] = np.cumsum(new) - 1
        before, same = np.full(len(values), -1), ~new[1:]
        before[self.order[1:][same]] = self.order[:-1][same]
        #: for each place the first of the passages in which nothing before it has its value; it is the last such passage's start itself
        self.first = np.maximum(before + 1, np.arange(len(values)) - t + 1)
        #: how many values each passage has, repeated ones once
        self.n = self.distinct(np.ones(len(values), bool)) if same.any() else np.full(len(values) - t + 1, t)

    @cached_property
    def hashes(self) -> np.ndarray:
        return _passage_hashes(self.values, self.t)

    def distinct(self, some: np.ndarray) -> np.ndarray:
        """How many values each passage has, repeated ones once, of those in some places."""
        return _counted(self.first, np.flatnonzero(some))[: len(self.first) - self.t + 1]

    def places(self, other: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Where the value of each of other's places begins and ends in order."""
        at = np.minimum(np.searchsorted(self.uniq, other.uniq), len(self.uniq) - 1)
        low = np.where(self.uniq[at] == other.uniq, self.begin[at], -1)
        return low[other.rank], np.where(low < 0, -1, low + self.many[at])[other.rank]


def near(a: Sequence, b: Sequence, some: np.ndarray, most: int = 1 << 21, places: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Those of a's passages that start at some places (a mask) and are similar to some passage of b.

    A value that both have, at a place of a and one of b, counts for a rectangle of passages of a and b: those in which
    both places are the value's first. So the sum of all rectangles is the intersection of each two passages.
    """
    t, (low, high) = a.t, places or b.places(a)
    rows, out = np.flatnonzero(some & (OF * a.distinct(high > low) >= NEED * a.n)), []  # else the similarity can't be reached
    for r in np.array_split(rows, -(-len(rows) // max(1, min(256, most // len(b.values) - t)))) if len(rows) else []:
        p = np.arange(r[0], r[-1] + t)
        p = p[high[p] > low[p]]
        top, end = np.searchsorted(r, a.first[p]), np.searchsorted(r, p, "right")
        p, top, end = p[end > top], top[end > top], end[end > top]
        many = high[p] - low[p]
        q = b.order[np.repeat(low[p] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        held = np.zeros(len(b.values), bool)
        held[q] = True
        c = np.flatnonzero(OF * b.distinct(held) >= NEED * b.n)
        if not len(c):
            continue
        top, end, left, right = np.repeat(top, many), np.repeat(end, many), np.searchsorted(c, b.first[q]), np.searchsorted(c, q, "right")
        wide, size = len(c) + 1, (len(r) + 1) * (len(c) + 1)
        both = np.bincount(np.r_[top * wide + left, end * wide + right], minlength=size) - np.bincount(np.r_[top * wide + right, end * wide + left], minlength=size)
        both = both.astype(np.int32).reshape(-1, wide).cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)[:-1, :-1]
        out.append(r[(OF * both >= NEED * (a.n[r][:, None] + b.n[c] - both)).any(1)])
    return np.concatenate(out) if out else rows[:0]


def compared(x: Sequence, y: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages of x, and of y, that the other text repeats."""
    nothing = np.zeros(0, np.int64)
    if min(len(x.values), len(y.values)) < x.t:
        return nothing, nothing
    at = [v.places(u) for u, v in ((x, y), (y, x))]
    may = [OF * u.distinct(high > low) >= NEED * u.n for u, (low, high) in zip((x, y), at, strict=True)]
    if not may[0].any() or not may[1].any():
        return nothing, nothing
    ha, hb = x.hashes, y.hashes
    common = np.intersect1d(ha[may[0]], hb[may[1]])
    out = []
    for u, v, h, some, where in ((x, y, ha, may[0], at[0]), (y, x, hb, may[1], at[1])):
        exact = np.zeros(len(h), bool)
        if len(common):
            exact[some] = common[np.minimum(np.searchsorted(common, h[some]), len(common) - 1)] == h[some]
        left = some & ~exact
        exact[near(u, v, left, places=where) if left.any() else nothing] = True
        out.append(np.flatnonzero(exact))
    return out[0], out[1]


def _masked(size: int, runs: list[dict] | None, less: int = 0) -> np.ndarray:
    """Places that runs (start, end) hold, each run's end brought forward by less."""
    out = np.zeros(size, bool)
    for r in runs or ():
        out[r["start"] : max(r["start"], r["end"] - less)] = True
    return out


def _stretches(at: np.ndarray) -> list[dict]:
    """Ascending places as runs (start, end)."""
    if not len(at):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    return [{"start": int(a), "end": int(z) + 1} for a, z in zip(at[new], at[np.r_[new[1:] - 1, len(at) - 1]], strict=True)]


def _told(tids: list[int], starts: list[np.ndarray], words: int) -> pa.RecordBatch:
    """(tid, start, end) of the stretches of words that passages starting there cover."""
    spans = [(k, r["start"], r["end"]) for k, at in zip(tids, starts, strict=True) for r in _runs(at, words)]
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["tid", "start", "end"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_words, passages) of every row: array of (start, end) word numbers that another row repeats.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A passage has at least `words` of
    them, and its five-word shingles are equal to, or 0.8 similar to, those of a passage of the same length in a row with
    another text; a text that several rows have repeats as a whole. Null, empty and shorter texts have no
    passages; a passage that only its own text repeats doesn't count; other columns are left out; an
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    slots, t = slots_of(docs.sparkSession), words - WIDTH + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row its id, words and text's number; then the task's signatures by slot."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packets() -> Iterator[pa.RecordBatch]:
            for b in packed(iter(held), slots):
                nothing = [pa.nulls(b.num_rows, k) for k in (kind, pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nothing, *b.columns], names)
            held.clear()

        names, kind = ["id", "n", "tid", "slot", "data"], pa.null()
        for b in slices(batches, "text"):
            values, edges, n, tid = sequences(b.column(1))
            kind = b.column(0).type
            _, _, doc, keys = signed_windows(values, edges, t)
            held.append((keys, tid[doc]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(tid, mask=n < words), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names)
            if sum(len(k) for k, _ in held) >= MOST_HELD:
                yield from packets()
        if held:
            yield from packets()

    scanned = stored(rows.mapInArrow(lean(scan), f"id {key}, n long, tid long, slot int, data binary"))
    measured = cut(scanned.where("slot is null").select("id", "n", "tid"))
    texts = measured.where("tid is not null").groupBy("tid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("many"))
    groups = stored(shared(scanned.where("slot is not null").select("slot", "data"), slots))
    dropped(scanned)
    mine = groups.groupBy("owner").agg(F.collect_list("g").alias("gs"))  # as many as a text has windows at most
    wanted = cut(mine.join(texts, F.col("owner") == F.col("tid")).select("tid", "gs", "id"))
    # dealt by tid for good, so that no later join moves the sequences again but for those of the other text of a pair
    held = dealt(texts_of(rows, wanted, "tid", "gs").mapInArrow(lean(fetcher(slots, t)), f"tid long, seq binary, runs {SPAN}, wins binary").dropDuplicates(["tid"]), partitions(docs.sparkSession), "tid")

    tested = cut(_leading_pairs(groups))
    swept(docs.sparkSession)
    found = [cut(_compared_pairs(tested, held, t, words))]
    swept(docs.sparkSession)
    found.append(cut(_exact_of_rest(held, found[0], slots, t, words)))
    swept(docs.sparkSession)
    open_ = cut(held.join(_spans(found), "tid", "left").select("tid", "seq", "runs", "spans").mapInArrow(lean(opener(t, words)), "tid long, starts binary"))
    if not open_.isEmpty():
        found.append(cut(_near_of_rest(groups, tested, held, open_, t, words)))

    whole = texts.where("many > 1").select("tid", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))
    out = measured.join(_spans([*found, whole]).mapInArrow(lean(joined), f"tid long, passages {SPAN}"), "tid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("passages", F.array().cast(SPAN)).alias("passages"))


def _spans(found: list[DataFrame]) -> DataFrame:
    told = found[0]
    for f in found[1:]:
        told = told.unionByName(f)
    return told.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed spans of a text as maximal stretches."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            some: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if some and s["start"] <= some[-1]["end"]:
                    some[-1]["end"] = max(some[-1]["end"], s["end"])
                else:
                    some.append(s)
            out.append(some)
        yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(out, _SPANS)], ["tid", "passages"])


def fetcher(slots: int, t: int):
    """Of texts (tid, gs, text): their sequences, where passages of the signatures gs start, and the windows of these."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, edges, _, tid = sequences(b.column(2))
            first, last, doc, keys = signed_windows(values, edges, t)
            gs = b.column(1)
            owner = np.repeat(np.arange(b.num_rows), np.diff(gs.offsets.to_numpy()))
            held = np.sort(mix(gs.values[gs.offsets[0].as_py() : gs.offsets[len(gs)].as_py()].to_numpy().view(U64) ^ mix(owner)))
            g = number_of(keys, slots)
            mine = mix(g ^ mix(doc))
            ok = np.flatnonzero(held[np.minimum(np.searchsorted(held, mine), max(0, len(held) - 1))] == mine) if len(held) else np.zeros(0, np.int64)
            ok = ok[np.argsort(doc[ok], kind="stable")]
            first, last, doc = first[ok], last[ok], doc[ok]
            cover = np.cumsum(np.bincount(first, minlength=len(values) + 1) - np.bincount(last + 1, minlength=len(values) + 1)) > 0
            found = np.zeros(len(ok), WINDOW)
            found["g"], found["first"], found["last"] = g[ok], first - edges[doc], last - edges[doc]
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            tids, seqs, runs, wins = [], [], [], []
            for i, (want, have) in enumerate(zip(b.column(0).to_pylist(), tid.tolist(), strict=True)):
                if want == have:  # an id may come with several texts
                    tids.append(want)
                    seqs.append(values[edges[i] : edges[i + 1]].tobytes())
                    runs.append(_stretches(np.flatnonzero(cover[edges[i] : edges[i + 1]])))
                    wins.append(found[cuts[i] : cuts[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(seqs, pa.binary()), pa.array(runs, _SPANS), pa.array(wins, pa.binary())], ["tid", "seq", "runs", "wins"])

    return fetch


def _leading_pairs(groups: DataFrame) -> DataFrame:
    """(a, b), no two texts twice: a leads the signatures of b, and of such leaders is the one with which b shares most."""
    n = groups.where("owner <> leader").groupBy("owner", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("owner").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
    return best.groupBy(F.least("owner", "leader"), F.greatest("owner", "leader")).agg(F.min(F.struct(F.col("leader").alias("a"), F.col("owner").alias("b"))).alias("pair")).select("pair.a", "pair.b")


def _compared_pairs(pairs: DataFrame, held: DataFrame, t: int, words: int) -> DataFrame:
    """(tid, start, end): what the texts of each pair repeat of the other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in pairs_of_blocks(batches, lambda data: Sequence(np.frombuffer(data, np.uint32), t)):
            tids, starts = [], []
            for a, b, x, y in found:
                tids += [a, b]
                starts += compared(x, y)
            yield _told(tids, starts, words)

    return together(pairs, held.select(F.col("tid").alias("sid"), F.col("seq").alias("data"))).mapInArrow(lean(compare), "tid long, start int, end int").distinct()


def _exact_of_rest(held: DataFrame, spans: DataFrame, slots: int, t: int, words: int) -> DataFrame:
    """(tid, start, end) of passages in shared windows that spans doesn't confirm and another text has as well."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of passages in shared windows: packed where they are confirmed, else a row each."""
        for b in batches:
            sure, sure_of, open_, open_of, places = [], [], [], [], []
            for tid, seq, runs, spans in zip(b.column("tid").to_pylist(), b.column("seq"), b.column("runs").to_pylist(), b.column("spans").to_pylist(), strict=True):
                h = _passage_hashes(np.frombuffer(seq.as_buffer(), np.uint32), t)
                likely = _masked(len(h), runs)
                known = _masked(len(h), spans, words - 1) & likely
                at = np.flatnonzero(likely & ~known)
                sure.append(h[known])
                sure_of.append(np.full(int(known.sum()), tid, np.int64))
                open_.append(h[at])
                open_of.append(np.full(len(at), tid, np.int64))
                places.append(at.astype(np.int32))
            packets = dict(pack_keys(np.concatenate(sure), np.concatenate(sure_of), slots))
            loose = np.zeros(sum(map(len, open_)), OPEN)
            for name, x in (("h", open_), ("tid", open_of), ("at", places)):
                loose[name] = np.concatenate(x)
            to = slot_of(loose["h"], slots).astype(np.int64)
            loose["h"] = low(loose["h"])
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(slots + 1))
            found = [s for s in range(slots) if s in packets or cuts[s + 1] > cuts[s]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([packets.get(s) for s in found], pa.binary()), pa.array([loose[order[cuts[s] : cuts[s + 1]]].tobytes() for s in found], pa.binary())], ["slot", "sure", "open"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages not yet confirmed that another text has, slot after slot."""

        def confirmed() -> pa.RecordBatch:
            loose = np.concatenate([np.frombuffer(x, OPEN) for x in opens])
            h, of, at = (np.ascontiguousarray(loose[n]) for n in ("h", "tid", "at"))
            wanted = np.unique(h)
            keys, owners = [h], [of]
            for data in packets:
                k, o = unpack_keys(data)
                if len(wanted):
                    some = wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k
                    keys.append(k[some])
                    owners.append(o[some])
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            several = np.unique(keys[1:][(keys[1:] == keys[:-1]) & (owners[1:] != owners[:-1])])
            good = np.isin(h, several)
            return pa.RecordBatch.from_arrays([pa.array(of[good]), pa.array(at[good]), pa.array(at[good] + np.int32(words))], ["tid", "start", "end"])

        now, packets, opens = None, [], []
        for b in batches:
            for slot, sure, loose in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if slot != now and opens:
                    yield confirmed()
                    packets, opens = [], []
                now = slot
                if sure.is_valid:
                    packets.append(sure.as_py())
                opens.append(loose.as_py())
        if opens:
            yield confirmed()

    left = held.join(_spans([spans]), "tid", "left").select("tid", "seq", "runs", "spans").mapInArrow(lean(rest), "slot int, sure binary, open binary")
    return left.repartition(slots, "slot").sortWithinPartitions("slot").mapInArrow(lean(repeated), "tid long, start int, end int")


def opener(t: int, words: int):
    """Texts with passages in shared windows that nothing has confirmed, and where these start."""

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, starts = [], []
            for i, (seq, runs, spans) in enumerate(zip(b.column("seq"), b.column("runs").to_pylist(), b.column("spans").to_pylist(), strict=True)):
                size = len(seq.as_buffer()) // 4 - t + 1
                at = np.flatnonzero(_masked(size, runs) & ~_masked(size, spans, words - 1))
                if len(at):
                    keep.append(i)
                    starts.append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("tid").take(pa.array(keep, pa.int64())), pa.array(starts, pa.binary())], ["tid", "starts"])

    return openings


def _sequences_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The batch's sequences behind each other, and their n + 1 offsets."""
    seqs = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("seq")]
    return np.concatenate([np.zeros(0, np.uint32), *seqs]), np.r_[0, np.cumsum([len(x) for x in seqs], dtype=np.int64)]


def few_windows(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about so many windows, a text of more alone: each is a stretch of its text when it leaves."""
    for b in batches:
        many = np.array([len(x.as_buffer()) // WINDOW.itemsize for x in b.column("wins")], np.int64)
        part = (np.cumsum(many) - many) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield b.slice(a, z - a)


def enough(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether passages of n and m different values or more can be similar, if they have at most so many in common."""
    return (both * (OF + NEED) >= NEED * (n + m)) & (OF * both >= NEED * np.maximum(n, m))


class Block:
    """Stretches of several texts, to find those that have passages similar to a given one's."""

    def __init__(self, known: list[tuple[int, np.ndarray]], t: int):
        self.tids, self.parts, self.t = np.array([k for k, _ in known]), [p for _, p in known], t
        size = np.array([len(p) for p in self.parts])
        self.flat, self.edges = np.concatenate(self.parts), np.r_[0, np.cumsum(size)]
        keys = np.repeat(np.arange(len(known), dtype=U64), size) << U64(32) | self.flat
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
        own = keys[order[new]]
        before = np.full(len(keys), -1)
        before[order[1:][~new[1:]]] = order[:-1][~new[1:]]
        #: as in Sequence, but for the places of all parts behind each other: the first of the passages that count a place's value there
        self.first = np.maximum(np.maximum(before + 1, np.arange(len(keys)) - t + 1), np.repeat(self.edges[:-1], size))
        #: how many values the passage from each place on has, repeated ones once; past a part's last passage it means nothing
        self.n = _counted(self.first, np.arange(len(keys)))
        #: distinct values that each passage of a part has at least
        self.least = np.maximum(t - size + np.bincount((own >> U64(32)).astype(np.int64), minlength=len(known)), 1)
        #: each part's different values, ordered by value, and the parts that they are of
        own = np.sort(own << U64(32) | own >> U64(32))
        self.sorted, self.part_of = (own >> U64(32)).astype(np.uint32), own.astype(np.uint32).astype(np.int32)
        #: the texts, and the values of each as often as it has parts that hold them
        self.texts, of = np.unique(self.tids, return_inverse=True)
        self.by_text = np.sort(of[self.part_of].astype(U64) << U64(32) | self.sorted)

    def found(self, opens: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        """(tid, starts) of those passages of opens (tid, at, values, starts) that are similar to one of another text.

        First, for all opens at once: most passages of a popular signature have too much that no other text here has.
        """
        size = np.array([len(x[2]) for x in opens])
        edges = np.r_[0, np.cumsum(size)]
        values, of = np.concatenate([x[2] for x in opens]), np.repeat(np.arange(len(opens), dtype=U64), size)
        tids = np.array([x[0] for x in opens])
        text = np.minimum(np.searchsorted(self.texts, tids), len(self.texts) - 1)
        text = np.where(self.texts[text] == tids, text, len(self.texts)).astype(U64)
        n = np.maximum(self.t - size + np.bincount((np.unique(of << U64(32) | values) >> U64(32)).astype(np.int64), minlength=len(opens)), 1)
        many = np.searchsorted(self.sorted, values, "right") - np.searchsorted(self.sorted, values)
        mine = np.repeat(text, size) << U64(32) | values
        common = np.r_[0, np.cumsum(many > np.searchsorted(self.by_text, mine, "right") - np.searchsorted(self.by_text, mine))]
        which, start = np.repeat(np.arange(len(opens)), [len(x[3]) for x in opens]), np.concatenate([x[3] for x in opens])
        first = edges[which] + start
        may = enough(common[first + self.t] - common[first], n[which], self.least.min())
        for i in np.unique(which[may]).tolist():
            tid, at, a, _ = opens[i]
            yield tid, at + self.similar(tid, a, start[may & (which == i)])

    def similar(self, tid: int, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Those of a's passages at starts that are similar to one of another text than tid."""
        own = Sequence(a, self.t)
        low = np.searchsorted(self.sorted, own.uniq)
        many = np.searchsorted(self.sorted, own.uniq, "right") - low
        held = self.part_of[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        both = np.bincount(held, minlength=len(self.parts))
        some = np.flatnonzero(enough(both, own.n[starts].min(), self.least) & (self.tids != tid))
        if not len(some):
            return some
        some = some[np.argsort(-both[some], kind="stable")]
        has = np.zeros((len(own.uniq), len(self.parts)), bool)  # a window has less than two passages' values
        has.ravel()[np.repeat(np.arange(len(own.uniq)) * len(self.parts), many) + held] = True
        found, open_ = np.zeros(len(own.n), bool), np.zeros(len(own.n), bool)
        open_[starts] = True
        for parts in np.split(some, [256, *range(2048, len(some), 2048)]):  # mostly the first ones are enough
            # of each open passage, how many places hold a value that the part has
            common = np.zeros((len(a) + 1, len(parts)), np.int32)
            np.cumsum(has[own.rank[:, None], parts], axis=0, out=common[1:])
            at = np.flatnonzero(open_)
            may = enough(common[at + self.t] - common[at], own.n[at][:, None], self.least[parts]).T
            good = np.flatnonzero(may.any(1))
            if not len(good):
                continue
            parts, may = parts[good], may[good]
            good = np.flatnonzero(self._reached(own, parts, at, may))
            for i in good.tolist():
                left = np.zeros(len(own.n), bool)
                left[at[may[i]]] = True
                left &= open_
                if left.any():
                    new = near(own, Sequence(self.parts[parts[i]], self.t), left)
                    found[new], open_[new] = True, False
                    if not open_.any():
                        return np.flatnonzero(found)
        return np.flatnonzero(found)

    def _reached(self, own: Sequence, parts: np.ndarray, at: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Of each of the parts, whether one of its passages has enough of the values between own's passages at those places that may be similar."""
        t = self.t
        first, last = at[may.argmax(1)], at[len(at) - 1 - may[:, ::-1].argmax(1)] + t
        n = np.where(may, own.n[at], t).min(1)
        size = self.edges[parts + 1] - self.edges[parts]
        of, begin = np.repeat(np.arange(len(parts)), size), np.cumsum(size) - size
        place = np.arange(len(of)) + np.repeat(self.edges[parts] - begin, size)
        rank = np.minimum(np.searchsorted(own.uniq, self.flat[place]), len(own.uniq) - 1)
        earliest, latest = own.order[own.begin], own.order[own.begin + own.many - 1]
        inside = np.flatnonzero((own.uniq[rank] == self.flat[place]) & (earliest[rank] < last[of]) & (latest[rank] >= first[of]))
        both = _counted(self.first[place] - (self.edges[parts] - begin)[of], inside)
        passage = np.arange(len(of)) - begin[of] <= size[of] - t
        return np.bincount(of[passage & enough(both, n[of], self.n[place])], minlength=len(parts)) > 0


def _near_of_rest(groups: DataFrame, tested: DataFrame, held: DataFrame, open_: DataFrame, t: int, words: int) -> DataFrame:
    """(tid, start, end) of open passages that are similar to one of another text in a window of the same signature.

    Signatures of two texts that have been compared already tell nothing new and are left out.
    """
    kind = "g long, blocks long, tid long, at int, part binary, starts binary"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the signatures gs: the sequence that their passages cover, and which of them are open if starts are told;
        else windows of equal content once, as far as the task remembers."""
        seen: set[tuple[int, bytes]] = set()
        for b in few_windows(batches):
            values, edges = _sequences_of(b)
            wins = [np.frombuffer(x.as_buffer(), WINDOW) for x in b.column("wins")]
            doc = np.repeat(np.arange(b.num_rows), [len(x) for x in wins])
            wins = np.concatenate([np.zeros(0, WINDOW), *wins])
            g, first, last = wins["g"], wins["first"] + edges[doc], wins["last"] + edges[doc]
            gs = b.column("gs")
            owner = np.repeat(np.arange(b.num_rows), np.diff(gs.offsets.to_numpy()))
            wanted, blocks = (x.to_numpy() for x in gs.values.slice(gs.offsets[0].as_py(), len(owner)).flatten())
            asked = mix(wanted.view(U64) ^ mix(owner))
            order = np.argsort(asked)
            asked, blocks = asked[order], blocks[order]
            mine = mix(g ^ mix(doc))
            place = np.minimum(np.searchsorted(asked, mine), max(0, len(asked) - 1))
            some = asked[place] == mine if len(asked) else np.zeros(len(mine), bool)
            if "starts" in b.schema.names:
                at = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) + e for x, e in zip(b.column("starts"), edges, strict=False)])
                a, z = np.searchsorted(at, first), np.searchsorted(at, last, "right")
                some = np.flatnonzero(some & (z > a))
                starts = [(at[a[i] : z[i]] - first[i]).astype(np.int32).tobytes() for i in some]
            else:
                some = np.flatnonzero(some)
                starts = [None] * len(some)
            first, end, doc = first[some], last[some] + t, doc[some]
            parts = [values[a:z].tobytes() for a, z in zip(first.tolist(), end.tolist(), strict=True)]
            if "starts" not in b.schema.names:
                new = []
                for i, window in enumerate(zip(g[some].tolist(), parts, strict=True)):
                    if window not in seen:
                        seen.add(window)
                        new.append(i)
                if len(seen) > 1 << 16:
                    seen.clear()
                first, doc, some, parts, starts = first[new], doc[new], some[new], [parts[i] for i in new], [None] * len(new)
            columns = [pa.array(g[some].view(np.int64)), pa.array(blocks[place[some]]), b.column("tid").take(pa.array(doc)), pa.array((first - edges[doc]).astype(np.int32)), pa.array(parts, pa.binary()), pa.array(starts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "blocks", "tid", "at", "part", "starts"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open windows against the others of their block; rows are ordered by block, the others first."""
        now, known, opens = None, {}, []

        def found() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal known, opens
            if opens and known:
                known = known if isinstance(known, Block) else Block([(k, np.frombuffer(p, np.uint32)) for p, k in known.items()], t)
                yield from known.found(opens)
            opens = []

        for b in batches:
            done: list[tuple[int, np.ndarray]] = []
            for g, i, j, tid, at, part, starts in zip(*(b.column(c).to_pylist() for c in ("g", "i", "j", "tid", "at", "part", "starts")), strict=True):
                if (g, i, j) != now:
                    done += found()
                    now, known = (g, i, j), {}
                if starts is None:
                    known.setdefault(part, tid)  # windows of equal content once
                else:
                    opens.append((tid, at, np.frombuffer(part, np.uint32), np.frombuffer(starts, np.int32)))
                    if len(opens) >= 1024:
                        done += found()
            yield _told([k for k, _ in done], [x for _, x in done], words)
        done = [*found()]
        yield _told([k for k, _ in done], [x for _, x in done], words)

    told = tested.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("last"))
    fresh = groups.where("m > 2").select("g", "owner", "m").unionByName(groups.where("m = 2").join(told, ["first", "last"], "left_anti").select("g", "owner", "m"))
    lists = F.collect_list(F.struct("g", F.ceil(F.col("m") / BLOCK).alias("blocks"))).alias("gs")  # as many as a text has windows at most
    gs = fresh.groupBy(F.col("owner").alias("tid")).agg(lists)
    asked = cut(held.join(open_.join(gs, "tid"), "tid").select("tid", "seq", "wins", "starts", "gs").mapInArrow(lean(cut_out), kind))
    gs = groups.join(asked.select("g").distinct(), "g", "left_semi").groupBy(F.col("owner").alias("tid")).agg(lists)
    known = held.join(gs, "tid").select("tid", "seq", "wins", "gs").mapInArrow(lean(cut_out), kind)
    all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = asked.select("g", F.pmod(F.xxhash64("tid", "at"), "blocks").alias("i"), all_.alias("j"), "tid", "at", "part", "starts")
    right = known.select("g", all_.alias("i"), F.pmod(F.xxhash64("part"), "blocks").alias("j"), "tid", "at", "part", "starts")
    blocks = right.unionByName(left).repartition(partitions(groups.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j", F.col("starts").isNotNull(), "tid", "at")
    return blocks.mapInArrow(lean(hold), "tid long, start int, end int").distinct()
