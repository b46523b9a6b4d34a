"""Letters of whole Arrow batches as flat numpy arrays, for counts over every letter and for folds that expressions don't reach."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of a batch are taken in slices of about this many bytes, a longer sequence alone.
SLICE = 4 << 20


class Flat:
    """Strings of a batch behind each other as bytes; a null is an empty one."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_string())
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, self.n + 1, 8 * column.offset) if self.n else np.zeros(1, np.int64)
        data = column.buffers()[2] if self.n else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.lengths = np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The number of its string for each byte."""
        return np.repeat(np.arange(self.n), self.lengths)

    def places(self) -> np.ndarray:
        """Each byte's place in its string, from 0."""
        return np.arange(len(self.data)) - np.repeat(self.offsets[:-1], self.lengths)


def sliced(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over batches cut so that each holds about SLICE bytes of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for a, z in stretches(b.column(column), SLICE):
                yield f(b.slice(a, z - a))

    return run


def stretches(column: pa.Array, size: int) -> list[tuple[int, int]]:
    """Stretches of rows, each of about so many bytes of a column of strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // size)) + 1).tolist(), len(column)]
    return list(zip(cuts, cuts[1:], strict=False))


def in_stretches(f: Callable[..., pa.Array], size: int, column: pa.Array, *beside: pa.Array) -> pa.Array:
    """f over a column of strings and others beside it, taken in stretches of about so many bytes."""
    return pa.concat_arrays([f(*(x.slice(a, z - a) for x in (column, *beside))) for a, z in stretches(column, size)])


def codes(text: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings behind each other, and where each string begins among them; of ASCII these are the bytes."""
    if not len(text.data) or text.data.max() < 128:
        return text.data, text.offsets
    begins = np.r_[0, np.cumsum((text.data & 0xC0) != 0x80)]
    return np.frombuffer(text.data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[text.offsets]


def strings(found: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings of code points that stand behind each other; null where told."""
    if found.dtype != np.uint8:
        found = found.astype(np.uint32)
        offsets = np.r_[0, np.cumsum(1 + (found > 0x7F) + (found > 0x7FF) + (found > 0xFFFF))][offsets]
        found = np.frombuffer(found.tobytes().decode("utf-32-le").encode(), np.uint8)
    there = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [there, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))])
    return text.cast(pa.string())


def nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def listed(values: pa.Array, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    """Values that stand behind each other as lists of so many."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values, mask=pa.array(null))


def odd(found: np.ndarray) -> np.ndarray:
    """Which code points are other than A, C, G, T of either case."""
    return ACGT[found] == 4 if found.dtype == np.uint8 else (found > 0xFF) | (ACGT[np.minimum(found, 0xFF)] == 4)


def counted(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of small non-negative keys, and how many rows, or how much weight, each has."""
    wide = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    code = np.zeros(len(keys[0]), np.int64)
    for k, w in zip(keys, wide, strict=True):
        code = code * w + k
    kinds, inverse = np.unique(code, return_inverse=True)
    n = np.bincount(inverse, weights, len(kinds)).astype(np.int64)
    out = []
    for w in reversed(wide):
        out.append(kinds % w)
        kinds = kinds // w
    return out[::-1], n


#: A, C, G, T (U) of either case as 0 to 3, all else as 4.
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _x in _c:
        CODES[ord(_x)] = _i
#: The same without U.
ACGT = CODES.copy()
ACGT[[ord("U"), ord("u")]] = 4
#: Letters of the nucleic alphabet with their ambiguity codes, and their complements.
LETTERS = "ACGTURYMKSWBDHVNacgturymkswbdhvn"
COMPLEMENTS = "TGCAAYRKMSWVHDBNtgcaayrkmswvhdbn"
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(COMPLEMENTS.encode(), np.uint8)
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: Capitals of a-z, all else as it is.
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x61:0x7B] -= 0x20


def dust_scores(seq: Flat, window: int = 64) -> np.ndarray:
    """How much each sequence repeats its three-letter words: 0 to 100; letters other than A, C, G, T are passed over.

    Up to `window` words all are taken together; of more, the worst stretch of that many that ends after word
    `window`. A stretch of n words with c of each kind scores 200 sum(c (c - 1) / 2) / (n (n - 1)). Pairs of equal words
    less than `window` apart are counted for all sequences at once: those that the last word of a stretch makes with words
    before it come in, those that the word before the stretch makes with words after it go out.
    """
    out = np.zeros(seq.n)
    codes = CODES[seq.data]
    some = codes < 4
    row, codes = seq.rows()[some], codes[some].astype(np.int64)
    if len(codes) < 3:
        return out
    whole = row[2:] == row[:-2]
    words, row = (codes[:-2] * 16 + codes[1:-1] * 4 + codes[2:])[whole], row[:-2][whole]
    n = np.bincount(row, minlength=seq.n)
    first = (np.cumsum(n) - n)[row]
    place, m = np.arange(len(words)), len(words)
    key = (row * 64 + words) * (m + window) + place
    ordered = np.sort(key)
    at = np.searchsorted(ordered, key)
    before = np.cumsum(np.r_[0, at - np.searchsorted(ordered, key - np.minimum(place - first, window - 1))])
    after = np.cumsum(np.r_[0, np.searchsorted(ordered, key + window - 1, "right") - at - 1])
    short = np.flatnonzero((n > 1) & (n <= window))
    start = np.cumsum(n) - n
    out[short] = 200 * (before[start + n] - before[start])[short] / (n * (n - 1))[short]
    # a stretch that ends with word i, i >= window: what came in up to i, less what went out before its first word
    late = np.flatnonzero(place - first >= window)
    if len(late):
        pairs = before[late + 1] - before[first[late]] - (after[late - window + 1] - after[first[late]])
        of = row[late]
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[new]] = 200 * np.maximum.reduceat(pairs, new) / (window * (window - 1))
    return out


def exceptions(seq: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs (pos, base, run) of one letter other than A, C, G, T of all sequences behind each other, and how many each has."""
    letters, offsets = codes(Flat(seq))
    at = np.flatnonzero(odd(letters))
    first = np.zeros(len(letters) + 1, bool)
    first[offsets] = True
    new = np.flatnonzero(first[at] | (letters[at] != letters[at - 1]))
    begins = at[new]
    row = np.searchsorted(offsets, begins, "right") - 1
    base = strings(letters[begins], np.arange(len(begins) + 1))
    run = np.diff(np.r_[new, len(at)])
    runs = pa.StructArray.from_arrays([pa.array((begins - offsets[row]).astype(np.int32)), base, pa.array(run.astype(np.int32))], ["pos", "base", "run"])
    return runs, np.bincount(row, minlength=len(seq))


def put_back(seq: str, found: Iterable[tuple[int, str, int]]) -> str:
    """A sequence with runs laid over its letters one after the other; runs beyond its end make it longer."""
    letters = list(seq)
    for pos, base, run in found:
        letters[pos : pos + run] = base if run == 1 else base * run
    return "".join(letters)


def overlaid(seq: pa.Array, found: pa.Array) -> pa.Array:
    """Sequences with runs (pos, base, run) laid over their letters; null where a run tells no number or base."""
    null = nulls(seq) | nulls(found)
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, runs = np.repeat(np.arange(len(seq)), counts), found.flatten()
    pos, base, run = (runs.field(i) for i in range(3))
    lacking = nulls(runs) | nulls(pos) | nulls(base) | nulls(run)
    null[row[lacking]] = True
    pos, run = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (pos, run))
    signs, where = codes(Flat(base))
    letters, offsets = codes(Flat(seq))
    plain = (pos >= 0) & (run >= 0) & (pos + run <= np.diff(offsets)[row]) & (np.diff(where) == 1) & ~lacking
    irregular = np.unique(row[~plain])
    use = ~np.isin(row, irregular)
    group, place = _spread(np.where(use, run, 0))
    sign = signs[where[:-1][use]] if use.any() else signs[:0]
    letters = letters.astype(np.result_type(letters, signs))
    letters[(offsets[row] + pos)[group] + place] = np.repeat(sign, run[use])  # of runs that overlap the last one stands
    out = strings(letters, offsets, null)
    if not (~null[irregular]).any():
        return out
    some = out.to_pylist()
    for i in irregular[~null[irregular]]:
        some[i] = put_back(seq[i].as_py(), ((x["pos"], x["base"], x["run"]) for x in found[i].as_py()))
    return pa.array(some, pa.string())


def contigs(seq: pa.Array, qual: pa.Array, gap: int) -> pa.Array:
    """(contigs, lead, end) of each sequence: its pieces between runs of at least gap letters other than A, C, G, T as (seq, qual, gap before it),
    how long the run at its begin is, and the one at its end; without contigs all of it is the run at its begin.
    """
    letters, offsets = codes(Flat(seq))
    at, null = np.flatnonzero(~odd(letters)), nulls(seq)
    of = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(of) > 0) | (np.diff(at) > gap)
    starts, row = at[new], of[new]
    ends = at[np.r_[new[1:], True]] + 1 if len(at) else at
    counts = np.bincount(row, minlength=len(seq))
    alone = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    before = starts - np.where(alone, offsets[row], np.r_[0, ends[:-1]] if len(ends) else ends)
    some, size = counts > 0, np.diff(offsets)
    last, lead = np.cumsum(counts) - 1, size.copy()
    lead[some] = before[(last - counts + 1)[some]]
    end = np.zeros(len(seq), np.int64)
    end[some] = offsets[1:][some] - ends[last[some]]
    edges = np.zeros(len(letters) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    kept, cuts = np.cumsum(edges, dtype=np.int8)[:-1] > 0, np.r_[0, np.cumsum(ends - starts)]
    without = nulls(qual)
    signs, where = codes(Flat(qual))
    if (np.diff(where) == size)[~without].all():
        whole = np.full(len(letters), ord("!"), signs.dtype)
        whole[np.repeat(~without, size)] = signs[np.repeat(~(without | null), np.diff(where))]
        quals = strings(whole[kept], cuts, without[row])
    else:
        told = qual.to_pylist()
        quals = pa.array([None if without[r] else told[r][a : a + n] for r, a, n in zip(row, starts - offsets[row], ends - starts, strict=True)], pa.string())
    pieces = pa.StructArray.from_arrays([strings(letters[kept], cuts), quals, pa.array(before.astype(np.int32))], ["seq", "qual", "gap"])
    return pa.StructArray.from_arrays([listed(pieces, counts, null), pa.array(lead.astype(np.int32), mask=null), pa.array(end.astype(np.int32), mask=null)], ["contigs", "lead", "end"])


def _numbers(text: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of digits within a string, and their values."""
    digit = (text.data >= 48) & (text.data <= 57)
    inside = np.r_[False, digit, False].astype(np.int8)
    step = np.diff(inside)
    cuts = text.offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(digit))])
    cuts = cuts[digit[cuts] & digit[cuts - 1]]  # two strings that touch
    starts, ends = np.sort(np.r_[np.flatnonzero(step == 1), cuts]), np.sort(np.r_[np.flatnonzero(step == -1), cuts])
    at = np.flatnonzero(digit)
    run = np.searchsorted(starts, at, "right") - 1
    value = np.bincount(run, (text.data[at] - 48.0) * 10.0 ** (ends[run] - 1 - at), len(starts)).astype(np.int64)
    return starts, ends, value


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts many items: the number of its group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def match_lines(cigar: pa.Array, md: pa.Array, reverse: pa.Array) -> pa.Array:
    """For each base of the read: `.` equal to the reference, a capital the reference's base, `-` none.

    Inserted and clipped bases have no reference base; deleted ones leave no trace. Turned round and
    complemented for reads on the reverse strand. Null without a CIGAR or an MD string. All strings of a batch are
    taken apart together: lengths of CIGAR operations give the line's places, MD's numbers and letters what stands there.
    """
    none = pc.or_(pc.is_null(md), pc.or_(pc.is_null(cigar), pc.is_in(cigar.fill_null(""), pa.array(["", "*"]))))
    empty = pa.scalar("", cigar.type)
    c, m = Flat(pc.if_else(none, empty, cigar)), Flat(pc.if_else(none, empty, md))
    # what MD tells, place by place, without deleted bases
    starts, _, value = _numbers(m)
    letter = LETTER[m.data]
    row = m.rows()
    before = np.r_[0, m.data[:-1]] if len(m.data) else m.data
    new = letter & ~(np.r_[False, letter[:-1]] & np.r_[False, row[1:] == row[:-1]]) if len(letter) else letter
    run = np.cumsum(new) - 1
    gone = (before[np.flatnonzero(new)] == ord("^")) & (row[np.maximum(np.flatnonzero(new) - 1, 0)] == row[np.flatnonzero(new)])
    kept = np.flatnonzero(letter)[~gone[run[letter]]] if letter.any() else np.zeros(0, np.int64)
    at = np.r_[starts, kept]
    order = np.argsort(at, kind="stable")
    many = np.r_[value, np.ones(len(kept), np.int64)][order]
    sign = np.r_[np.full(len(starts), ord("."), np.uint8), UPPER[m.data[kept]]][order]
    told, told_row = np.repeat(sign, many), np.repeat(row[at[order]], many) if len(at) else np.zeros(0, np.int64)
    told_first = np.searchsorted(told_row, np.arange(m.n + 1))
    # the line's places by CIGAR
    _, ends, value = _numbers(c)
    ok = ends < len(c.data)
    ends, value = ends[ok], value[ok]
    op, of = c.data[ends], c.rows()[ends]
    matched, inserted = np.isin(op, np.frombuffer(b"M=X", np.uint8)), np.isin(op, np.frombuffer(b"IS", np.uint8))
    group, place = _spread(np.where(matched | inserted, value, 0))
    used = np.cumsum(np.r_[0, np.where(matched, value, 0)])[:-1]  # reference bases before each operation, of all rows
    row_first = np.searchsorted(of, np.arange(c.n + 1))
    base = np.r_[used, 0][row_first[:-1]] if len(used) else np.zeros(c.n, np.int64)
    where = of[group]
    index = told_first[where] + used[group] - base[where] + place
    line = np.full(len(group), ord("-"), np.uint8)
    inside = matched[group]
    line[inside] = ord(".")
    inside &= index < told_first[where + 1]
    line[inside] = told[index[inside]]
    lengths = np.bincount(where, minlength=c.n)
    offsets = np.r_[0, np.cumsum(lengths)]
    back = reverse.fill_null(False).to_numpy(zero_copy_only=False)[where]
    turned = offsets[where] + offsets[where + 1] - 1 - np.arange(len(line))
    line = np.where(back, COMPLEMENT[line[np.where(back, turned, 0)]] if len(line) else line, line)
    text = pa.Array.from_buffers(pa.large_string(), c.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(line))])
    return pc.if_else(none, pa.scalar(None, pa.string()), text.cast(pa.string()))
