"""All texts whose sets of word shingles have a Jaccard similarity of 0.8 or more (operator 3).

Signatures are those of PartEnum. Two sets of at most t elements that are 0.8 similar differ in at most
k = 2 t / 9 elements. Sizes fall into bands that grow by 1/0.8; each set takes part with its own
band and the one below, and with its own and the one above, and k follows from the largest size of the two.
The domain is dealt by hash into n1 > k / 2 parts, of which one at least has no more than one
difference, and each part into three; leaving out one of the three in each way gives signatures
of which such a pair shares one. A part with an empty signature proves nothing: n1 is larger
than needed by a margin, and sets with more empty parts than that are paired among themselves by
the shingles of their prefix (any two similar sets share one of the first of an order).

Equal sets are one from the start, so copies cost nothing, and signatures that the same sets share are one group.
Sets that share a signature are compared with one of them first, the one that shares most. Where a group still
falls into several components, each set is compared with the one of another component that small histograms say is
nearest, twice. The last round takes the groups that are open even then, and compares all pairs of different components
that the histograms' bound allows, block with block: no link between components is lost; the histograms of such a group
are compared pair by pair, its texts only where these leave it possible.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.components import components
from readlake.llm.ragged import LOWER, NOT_SPACE, PIECE_BYTES, U64, Texts, mix, powers, slices, stream, windows
from readlake.llm.tables import cut, dealt, lean, partitions, sized, small_batches, stored, swept

WIDTH = 5
#: Similar: NEED * |A and B| >= ... as integers, 100 * intersection >= 80 * union.
NEED, OF = 80, 100
GROWTH = OF / NEED
MARGIN = 1.12
#: A histogram has as many bytes as this: so many cells, or four times as many for sets of up to SMALL elements.
CELLS = 128
FINE, SMALL = 4 * CELLS, 1000
#: Of groups, one in so many is used to find each set's nearest.
SOME = 8
BLOCK = 1024
_SEEDS = stream(3, 8)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, behind each other, and n + 1 offsets.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; a text of fewer words
    than width is one shingle, one without words has none.
    """
    texts = Texts(column)
    texts.data = LOWER[texts.data]
    starts, ends, doc = texts.words(NOT_SPACE)
    words = texts.hashes(starts, ends)
    values, at = windows(words, doc, width)
    of = doc[at] if len(at) else at
    count = np.bincount(doc, minlength=texts.n)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        p, whole = powers(width + 1), np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for i in range(width - 1):
                held = count[short] > i
                whole[held] += words[first[short][held] + i] * p[i + 1]
            whole = mix(whole ^ _SEEDS[0] ^ count[short].astype(U64))
        values, of = np.concatenate([values, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
    edges = np.searchsorted(of, np.arange(texts.n + 1))
    for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        values[a:z].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[keep], np.r_[0, np.cumsum(np.bincount(of[keep], minlength=texts.n))]


def set_ids(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A number for each set that equal sets share; sets without elements get none (0)."""
    n, full = np.diff(edges), np.diff(edges) > 0
    out = np.zeros(len(n), U64)
    if full.any():
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(values ^ _SEEDS[1]), edges[:-1][full])
            out[full] = mix(sums + n[full].astype(U64)) | U64(1)
    return out.view(np.int64)


def histograms(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """How many elements of each set fall into each of some cells: up to SMALL elements in many cells, told up to 3, else in few, told up to 255."""
    n, h = np.diff(edges), mix(values ^ _SEEDS[2])
    out = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        many = FINE if z - a <= SMALL else CELLS
        counts = np.bincount((h[a:z] % U64(many)).astype(np.int64), minlength=many)
        if many == FINE:
            two = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
            out.append((two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes())
        else:
            out.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
    assert len(out) == len(n)
    return out


def differences(h: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least how many elements the sets x and y differ in; 0 for a small and a large one. h: the histograms' bytes, n: sizes."""
    out = np.zeros(len(x), np.int64)
    for s in range(0, len(x), 1 << 14):
        u, v = x[s : s + (1 << 14)], y[s : s + (1 << 14)]
        fine, coarse = (n[u] <= SMALL) & (n[v] <= SMALL), (n[u] > SMALL) & (n[v] > SMALL)
        part = np.zeros(len(u), np.int64)
        if coarse.any():
            part[coarse] = np.abs(h[u[coarse]].astype(np.int16) - h[v[coarse]]).sum(1)
        if fine.any():
            a, b = h[u[fine]], h[v[fine]]
            part[fine] = sum(np.abs((a >> i & 3).astype(np.int8) - (b >> i & 3).astype(np.int8)).sum(1, dtype=np.int64) for i in (0, 2, 4, 6))
        out[s : s + (1 << 14)] = part
    return out


def sketches(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Of each set whether an odd number of its elements falls into each of 2 n to 4 n cells, a power of two, a bit each."""
    h, out = mix(values ^ _SEEDS[6]), []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        many = max(8, 2 << (z - a).bit_length())
        odd = np.bincount((h[a:z] & U64(many - 1)).astype(np.int64), minlength=many) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def sketch_differences(x: bytes, y: bytes) -> int:
    """At least how many elements two sets of these sketches differ in: an element in one of them alone turns one cell.

    The larger sketch is folded to the smaller one's cells.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    fold = lambda v: v if len(v) == n else np.bitwise_xor.reduce(v.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def most_differences(n: np.ndarray | int) -> np.ndarray | int:
    """How many elements two similar sets can differ in whose sizes have the sum n."""
    return n * (OF - NEED) // (OF + NEED)


def bands() -> np.ndarray:
    """The smallest size of each band; similar sets are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * OF // NEED + 1)
    return np.array(out)


_BANDS = bands()


def signatures(values: np.ndarray, edges: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the owners they belong to."""
    n = np.diff(edges)
    keys, of = [], []
    band = np.searchsorted(_BANDS, n, "right") - 1
    for shift in (0, 1):
        tag = band - shift  # bands tag and tag + 1
        some = np.flatnonzero((n > 0) & (tag >= 0))
        k = most_differences(2 * (_BANDS[np.maximum(tag, 0) + 2] - 1))
        some = some[k[some] > 0]  # without differences sets are equal, and one already
        if not len(some):
            continue
        parts = np.ceil(MARGIN * (k[some] // 2 + 1)).astype(np.int64)
        size = n[some]
        row = np.repeat(np.arange(len(some)), size)
        at = np.arange(int(size.sum())) + np.repeat(edges[some] - (np.cumsum(size) - size), size)
        v = values[at]
        h = mix(v ^ _SEEDS[3])
        first = np.cumsum(parts) - parts
        cell = (first[row] + (h >> U64(16)).astype(np.int64) % parts[row]) * 3 + (h & U64(0xFFFF)).astype(np.int64) % 3
        total = int(parts.sum()) * 3
        sums = np.zeros(total, U64)
        with np.errstate(over="ignore"):
            np.add.at(sums, cell, mix(v ^ _SEEDS[4]))
        held = np.bincount(cell, minlength=total).reshape(-1, 3)
        sums = sums.reshape(-1, 3)
        part_of = np.repeat(np.arange(len(some)), parts)
        place = (np.arange(len(part_of)) - first[part_of]).astype(U64) + (tag[some].astype(U64) << U64(40))[part_of]
        empty = np.zeros(len(part_of), bool)
        for out in range(3):
            i, j = (out + 1) % 3, (out + 2) % 3
            full = held[:, i] + held[:, j] > 0
            empty |= ~full
            with np.errstate(over="ignore"):
                key = mix((sums[:, i] + sums[:, j]) ^ mix(place * U64(4) + U64(out)))
            keys.append(key[full])
            of.append(some[part_of[full]])
        weak = np.flatnonzero(np.bincount(part_of[empty], minlength=len(some)) >= parts - k[some] // 2)
        for w in weak.tolist():
            s = some[w]
            prefix = values[edges[s] : edges[s] + n[s] - math.ceil(n[s] * NEED / OF - 1e-9) + 1]
            keys.append(mix(prefix ^ _SEEDS[5] ^ U64(int(tag[s]))))
            of.append(np.full(len(prefix), s))
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(keys), owners[np.concatenate(of)]


def pack_keys(keys: np.ndarray, owners: np.ndarray, slots: int) -> Iterator[tuple[int, bytes]]:
    """Signatures by slot: 40 bits of each, and the owner's place among the packet's owners."""
    slot = (keys >> U64(40)) % U64(slots)
    order = np.lexsort((owners, slot))
    keys, owners, slot = keys[order] & U64((1 << 40) - 1), owners[order], slot[order].astype(np.int64)
    edges = np.searchsorted(slot, np.arange(slots + 1)).tolist()
    for s, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
        if z > a:
            new = np.r_[True, owners[a + 1 : z] != owners[a : z - 1]]
            table, many = owners[a:z][new], np.diff(np.r_[np.flatnonzero(new), z - a])
            head = np.array([z - a, len(table)], np.int64).tobytes()
            yield s, head + table.tobytes() + (keys[a:z] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (keys[a:z] >> U64(32)).astype(np.uint8).tobytes() + zstandard.compress(many.astype(np.uint32).tobytes(), 1)


#: Signatures that a task holds before it packs them: with many of a task together, packets stay few and large.
MOST_HELD = 1 << 20


def packed(found: Iterator[tuple[np.ndarray, np.ndarray]], slots: int) -> Iterator[pa.RecordBatch]:
    """(slot, data) of a task's signatures and their owners."""

    def pack() -> pa.RecordBatch:
        packets = list(pack_keys(*(np.concatenate(x) for x in zip(*held, strict=True)), slots))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in packets], pa.int32()), pa.array([d for _, d in packets], pa.binary())], ["slot", "data"])

    held, n = [], 0
    for keys, owners in found:
        held.append((keys, owners))
        n += len(keys)
        if n >= MOST_HELD:
            yield pack()
            held, n = [], 0
    if held:
        yield pack()


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    table, at = np.frombuffer(data, np.int64, m, 16), 16 + 8 * m
    low, high = np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint8, n, at + 4 * n)
    many = np.frombuffer(zstandard.decompress(data[at + 5 * n :]), np.uint32)
    return low.astype(U64) | high.astype(U64) << U64(32), np.repeat(table, many)


def shared(packets: DataFrame, slots: int, once: bool = False) -> DataFrame:
    """(g, owner, leader, first, last, m, times): owners of each signature that m > 1 have, a leader among them, the smallest and the largest.

    packets: (slot, data). With once, signatures of a slot that the same owners have are one group: times tells how many
    they are, and g, a hash of the owners, is the same in every slot.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for slot, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if slot != now and held:
                    yield from groups(now, held)
                    held = []
                now = slot
                held.append(unpack_keys(data.as_py()))
        if held:
            yield from groups(now, held)

    def groups(slot: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        keys, owners = keys[several], owners[order[several]]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])] if len(keys) else np.zeros(0, bool)
        keys, owners = keys[new], owners[new]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(keys)])
        least, last, size = np.repeat(owners[first], size), np.repeat(owners[first + size - 1], size), np.repeat(size, size)
        # the leader is who shares most with others here: the text that a family of copies was made from shares with all of them
        names, place = np.unique(owners, return_inverse=True)
        share = np.bincount(place, np.where(size > 1, size, 0), len(names))[place] if len(names) else np.zeros(0)
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
        ranked = np.lexsort((owners, -share, number))
        leader = owners[ranked[first]][number] if len(first) else owners
        keep, times = size > 1, np.ones(len(keys), np.int64)
        g = (keys | U64(slot) << U64(40)).view(np.int64)
        if once and len(keys):
            with np.errstate(over="ignore"):
                lists = mix(np.add.reduceat(mix(owners.view(U64) ^ _SEEDS[7]), first)).view(np.int64)
            _, kept, many = np.unique(lists, return_index=True, return_counts=True)
            alone = np.zeros(len(first), np.int64)
            alone[kept] = many
            keep &= alone[number] > 0
            times, g = alone[number], lists[number]
        for a in range(0, len(g), 1 << 17):
            k = keep[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)][k]) for x in (g, owners, leader, least, last, size, times)], ["g", "owner", "leader", "first", "last", "m", "times"])

    dealt = packets.repartition(slots, "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(lean(find), "g long, owner long, leader long, first long, last long, m long, times long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size and the smallest id that links reach.

    Rows link where 100 * intersection >= 80 * union of their sets. A null or empty text, or one without
    words, has an empty set, links with nothing and is its own component; repeated texts link; a null id
    never names a component unless it stands alone; other columns are left out; an empty table gives
    an empty one. Elements are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    slots = 2 * partitions(docs.sparkSession)  # a slot's signatures are unpacked in one task, which bounds its memory

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PIECE_BYTES):
            values, edges = shingle_sets(b.column(1), width)
            n, sid = np.diff(edges), set_ids(values, edges)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sid, mask=n == 0), pa.array(histograms(values, edges), pa.binary()), pa.array(sketches(values, edges), pa.binary())], ["id", "n", "sid", "hist", "sketch"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            seen: set[int] = set()
            for b in slices(batches, "text", PIECE_BYTES):
                values, edges = shingle_sets(b.column(1), width)
                sid = set_ids(values, edges)
                new = np.array([s not in seen for s in sid.tolist()], bool) & np.isin(np.arange(len(sid)), np.unique(sid, return_index=True)[1])
                seen.update(sid[new].tolist())
                if len(seen) > 1 << 20:
                    seen.clear()  # a set signed twice does no harm
                keep = np.repeat(new, np.diff(edges))
                yield signatures(values[keep], np.r_[0, np.cumsum(np.diff(edges)[new])], sid[new])

        yield from packed(signed(), slots)

    measured = cut(rows.mapInArrow(lean(measure), f"id {key}, n long, sid long, hist binary, sketch binary"))
    # dealt by sid for good, so that no later join moves them again
    sets = dealt(measured.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hist").alias("hist"), F.first("sketch").alias("sketch")), partitions(docs.sparkSession), "sid")
    groups = stored(shared(rows.mapInArrow(lean(sign), "slot int, data binary"), slots, once=True).drop("last"))
    swept(docs.sparkSession)

    best = groups.where("owner <> leader").groupBy("leader", "owner").agg(F.sum("times").alias("n")).groupBy("owner").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
    tested = cut(best.select(F.least("leader", "owner").alias("a"), F.greatest("leader", "owner").alias("b")).distinct())
    links = cut(linked(pruned(tested, sets), sets, rows, width))
    for nearest in (1, 1, None):
        swept(docs.sparkSession)
        some = groups if nearest is None else groups.where(F.pmod("g", F.lit(SOME)) == 0)
        pairs = cut(crossed(some, components(links), sets, nearest).join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tested, links = tested.unionByName(pairs), cut(links.unionByName(linked(pruned(pairs, sets), sets, rows, width)))
    parts = components(links)
    named = sets.select("sid", "id").join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of = named.select("sid", "component").join(least, "component").select("sid", "component_id")
    out = measured.join(of, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def labelled(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """groups with the component so far of each owner (label) and of its group's leader (leader_label)."""
    parts = sized(cut(parts))
    for of, label in (("owner", "label"), ("leader", "leader_label")):
        groups = groups.join(parts.select(F.col("node").alias(of), F.col("component").alias(label)), of, "left").withColumn(label, F.coalesce(label, of))
    return groups


def of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that pairs name."""
    return sets.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")


def pruned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow that they are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = most_differences(b.column("n_a").to_numpy() + b.column("n_b").to_numpy()).tolist()
            ok = [sketch_differences(x, y) <= m for x, y, m in zip(b.column("s_a").to_pylist(), b.column("s_b").to_pylist(), most, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small = pairs.where(f"least(n_a, n_b) * {OF} >= greatest(n_a, n_b) * {NEED}")
    return cut(small.mapInArrow(lean(prune), "a long, b long"))


def crossed(groups: DataFrame, parts: DataFrame, sets: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs (a < b) of owners of one group and different components that sizes and histograms allow.

    Only groups that still fall into several components. With nearest, each owner is paired with that many
    at most, those with the nearest histograms: as components grow together by these, few pairs are
    left for a round without. A group is compared block with block, so that no task holds more than two
    blocks of it, and many small groups at once.
    """
    named = labelled(groups.where("m > 2"), parts)
    open_ = named.where("label <> leader_label").select("g").distinct()
    rows = cut(named.join(open_, "g", "left_semi").select("first", "g", "owner", "label", "m"))
    # signatures of one family differ in few of its sets: where all sets that share one with the first are fewer pairs, they are one group
    members = rows.groupBy("first", "owner").agg(F.min("label").alias("label"))
    dense = members.groupBy("first").agg(F.count(F.lit(1)).alias("d")).join(rows.groupBy("first").agg(F.sum("m").alias("work")), "first").where("d * d < work")
    dense = sized(cut(dense.select("first", "d")))
    whole = members.join(dense, "first").select("first", F.col("first").alias("g"), "owner", "label", F.col("d").alias("m"))
    rows = rows.join(dense, "first", "left_anti").unionByName(whole)
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    rows = rows.join(sets.select(F.col("sid").alias("owner"), "n", "hist"), "owner").withColumn("block", F.pmod(F.xxhash64("owner"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("first", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "owner", "label", "n", "hist")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        told = np.zeros(0, U64)  # pairs that this task has given out; groups of one family have the same first set, so they come here

        def fresh(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal told
            for b in found:
                key = mix(b.column(0).to_numpy().view(U64) ^ mix(b.column(1).to_numpy().view(U64)))
                key, at = np.unique(key, return_index=True)
                new = ~np.isin(key, told, assume_unique=True)
                told = np.union1d(told, key[new]) if len(told) < 1 << 22 else key[new]  # a pair told twice does no harm
                yield b.take(pa.array(at[new]))

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 1 << 15:
                t = one_each(pa.Table.from_batches(held))
                last = group_numbers(t)
                end = int(np.searchsorted(last, last[-1]))  # the last group may go on
                yield from fresh(pairs_within(t.slice(0, end), nearest))
                held = t.slice(end).to_batches()
        if held:
            yield from fresh(pairs_within(one_each(pa.Table.from_batches(held)), nearest))

    dealt_ = rows.repartition(partitions(groups.sparkSession), "first", "i", "j").sortWithinPartitions("first", "g", "i", "j", "owner")
    found = dealt_.mapInArrow(lean(compare), "a long, b long")
    if nearest is None:  # groups of two are one pair each, which their one row tells
        two = labelled(groups.where("m = 2 and owner <> leader"), parts).where("label <> leader_label")
        found = found.unionByName(two.select(F.least("leader", "owner").alias("a"), F.greatest("leader", "owner").alias("b")))
    return found.distinct()


def one_each(t: pa.Table) -> pa.Table:
    """Rows (g, i, j, owner) once; the same group may come from several slots. Rows are in order."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("g", "i", "j", "owner"):
        k = t.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return t.filter(pa.array(new))


def group_numbers(t: pa.Table) -> np.ndarray:
    keys = [t.column(c).to_numpy() for c in ("g", "i", "j")]
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def pairs_within(t: pa.Table, nearest: int | None, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups that may be similar, some rows' pairs after the other."""
    if not t.num_rows:
        return
    group = group_numbers(t)
    after = np.searchsorted(group, group, "right") - np.arange(t.num_rows) - 1
    owner, label, n, block, i, j = (t.column(c).to_numpy() for c in ("owner", "label", "n", "block", "i", "j"))
    h = np.frombuffer(b"".join(t.column("hist").to_pylist()), np.uint8).reshape(-1, CELLS)
    part = (np.cumsum(after) - after) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), t.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        many = after[a:z]
        x = np.repeat(np.arange(a, z), many)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        ok = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * OF >= np.maximum(n[x], n[y]) * NEED) & ((i[x] == j[x]) | (block[x] != block[y]))
        x, y = x[ok], y[ok]
        pair = np.unique(np.stack([owner[x], owner[y]]), axis=1, return_index=True)[1]  # the same two may share many groups
        x, y = x[pair], y[pair]
        far = differences(h, n, x, y)
        near = far <= most_differences(n[x] + n[y])
        x, y, far = x[near], y[near], far[near]
        if nearest is not None and len(x):
            order = np.lexsort((owner[y], far, x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
            x, y = x[rank < nearest], y[rank < nearest]
        yield pa.RecordBatch.from_arrays([pa.array(owner[x]), pa.array(owner[y])], ["a", "b"])


def linked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    wanted = of_pairs(pairs, sets).select("sid", "id")
    texts = texts_of(rows, wanted, "sid")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text", PIECE_BYTES):
            values, edges = shingle_sets(b.column(1), width)
            right = []
            for i, (have, want) in enumerate(zip(set_ids(values, edges).tolist(), b.column(0).to_pylist(), strict=True)):
                if have == want and want not in seen:  # an id may come with several texts, and rows may repeat
                    seen.add(want)
                    right.append(i)
            data = [values[edges[i] : edges[i + 1]].tobytes() for i in right]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(right, pa.int64())), pa.array(data, pa.binary())], ["sid", "elements"])

    held = dealt(texts.mapInArrow(lean(elements), "sid long, elements binary"), partitions(rows.sparkSession), "sid")
    mixed = together(pairs, held.select("sid", F.col("elements").alias("data")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in pairs_of_blocks(batches, lambda data: np.frombuffer(data, U64)):
            out: list[tuple[int, int]] = []
            for a, b, x, y in found:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if OF * both >= NEED * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return mixed.mapInArrow(lean(verify), "a long, b long").distinct()


def together(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(c, i, j, a, b, data): what pairs (a, b) need of held (sid, data), dealt so that pairs_of_blocks can read it.

    What pairs connect lies together, in blocks of about TOGETHER, so that data go to each block once, however many pairs name them.
    """
    slots = partitions(pairs.sparkSession)
    named = sized(cut(components(pairs))).select(F.col("node").alias("sid"), F.col("component").alias("c"))
    blocks = named.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("blocks"))
    placed = cut(named.join(sized(blocks), "c").select("sid", "c", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block")))
    told = pairs.join(sized(placed.select(F.col("sid").alias("a"), "c", F.col("block").alias("x"))), "a").join(sized(placed.select(F.col("sid").alias("b"), F.col("block").alias("y"))), "b")
    told = cut(told.select("c", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"))
    wanted = told.select("c", "i", "j", F.explode(F.array("a", "b")).alias("sid")).distinct()
    whole = wanted.join(held, "sid").select("c", "i", "j", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "data")
    mixed = whole.unionByName(told.select("c", "i", "j", "a", "b", F.lit(None).cast("binary").alias("data")))
    return mixed.repartition(slots, "c", "i", "j").sortWithinPartitions("c", "i", "j", F.col("data").isNull(), "a")


def pairs_of_blocks(batches: Iterator[pa.RecordBatch], read: Callable[[bytes], object]) -> Iterator[Iterator[tuple]]:
    """Of each batch the pairs (a, b, read(data of a), read(data of b)); data are read once in a block."""
    now, known = None, {}

    def found(t: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal now, known
        for c, i, j, a, b, data in zip(*(t.column(n).to_pylist() for n in ("c", "i", "j", "a", "b", "data")), strict=True):
            if (c, i, j) != now:
                now, known = (c, i, j), {}
            if data is not None:
                known[a] = read(data)
            elif a in known and b in known:
                yield a, b, known[a], known[b]

    for t in batches:
        yield found(t)


#: Sets of a component of pairs that are compared together; of larger ones block with block.
TOGETHER = 256
#: Bits, at most, of the filter that keeps texts nobody asks for out of a shuffle.
FILTER_BITS = 1 << 25


def texts_of(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(*columns, text) of the rows (id, text) that wanted (id, *columns) names.

    A filter of 64 bits for each id, as long as it stays under FILTER_BITS, goes to every task first, so that only texts
    that are wanted, and some few whose bit is, are shuffled for the exact join; with more ids the join does without.
    """
    bits = 1 << max(12, (64 * wanted.count()).bit_length())
    if bits <= FILTER_BITS:
        bit = F.pmod(F.xxhash64("id"), F.lit(bits))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        words = np.zeros(bits // 64, np.int64)
        for r in wanted.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(mask).alias("bits")).toLocalIterator():
            words[r["word"]] = r["bits"]
        table = rows.sparkSession.createDataFrame([(words.tolist(),)], "bits array<long>")
        held = F.get("bits", F.floor(bit / 64).cast("int")).bitwiseAND(mask) != 0
        rows = rows.crossJoin(F.broadcast(table)).where(held).select("id", "text")
    return rows.join(wanted.select(F.col("id").alias("wanted_id"), *columns), F.col("id").eqNullSafe(F.col("wanted_id"))).select(*columns, "text")
