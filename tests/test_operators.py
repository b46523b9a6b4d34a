import random

from pyspark.sql import functions as F

from readlake.operators import accessions, reads, reports, sorting, taxonomy
from readlake.schemas import READS

NODES = [(1, 1, "no rank", "root"), (2, 1, "kingdom", "Metazoa"), (3, 2, "order", "o"), (4, 3, "family", "f"), (5, 4, "genus", "g"), (6, 5, "species", "s"), (7, 3, "species", "t"), (8, 1, "kingdom", "Fungi"), (9, 4, "species", "u")]


def nodes(spark):
    return spark.createDataFrame(NODES, "taxid int, parent int, rank string, name string")


def test_annotation(spark):
    got = {r.taxid: (r.family, r.grp) for r in taxonomy.annotated(nodes(spark)).collect()}
    assert got == {1: (0, None), 2: (0, "animals"), 3: (0, "animals"), 4: (4, "animals"), 5: (4, "animals"), 6: (4, "animals"), 7: (0, "animals"), 8: (0, "fungi"), 9: (4, "animals")}


def test_lca(spark):
    parent = {n[0]: n[1] for n in NODES}

    def path(t):
        out = [t]
        while parent[t] != t:
            t = parent[t]
            out.append(t)
        return out[::-1]

    random.seed(2)
    cases = {"none": [0], "zero and one": [0, 7], "one": [7], "unknown": [99], "unknown and one": [99, 6]} | {f"r{i}": random.sample([0, *parent], random.randint(1, 4)) for i in range(60)}
    rows = [(k, t) for k, ts in cases.items() for t in ts + ts[:1]]
    got = {r.name: r.lca for r in taxonomy.lca(spark.createDataFrame(rows, "name string, taxid int"), nodes(spark)).collect()}
    for k, ts in cases.items():
        paths = [path(t) for t in ts if t in parent]
        want = None
        for level in zip(*paths, strict=False):
            if len(set(level)) == 1:
                want = level[0]
        assert got[k] == (want if paths else None), k


def test_a_cycle_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="go round"):
        taxonomy.paths(spark.createDataFrame([(1, 2), (2, 1)], "taxid int, parent int"))


def test_intervals_do_not_depend_on_order_or_pieces(spark):
    rows = [("AB000123", 9), ("AB124", 9), ("AB125", 8), ("AB127", 8), ("AB127", 8), ("C1", 1), ("D", 4), ("NZ_CP01", 5)]
    want = {("AB", 123, 2, 9), ("AB", 125, 1, 8), ("AB", 127, 1, 8), ("C", 1, 1, 1), ("D", 0, 1, 4), ("NZ_CP", 1, 1, 5)}
    for piece in (2, 1 << 16):
        df = spark.createDataFrame(random.sample(rows, len(rows)), "accession string, taxid int")
        iv = accessions.intervals(df, piece)
        assert {tuple(r) for r in iv.collect()} == want
        refs = spark.createDataFrame([("AB000124.7",), ("AB126.1",), ("NZ_CP01.1",), ("X",)], "accession string")
        assert {r.accession: r.taxid for r in accessions.with_taxa(refs, iv, piece=piece).collect()} == {"AB000124.7": 9, "AB126.1": 0, "NZ_CP01.1": 5, "X": 0}


def test_overlapping_intervals_take_the_first(spark):
    iv = spark.createDataFrame([("A", 1, 10, 7), ("A", 3, 2, 8), ("A", 3, 9, 6)], "prefix string, start long, count long, taxid int")
    refs = spark.createDataFrame([("A4",), ("A11",)], "accession string")
    assert {r.accession: r.taxid for r in accessions.with_taxa(refs, iv).collect()} == {"A4": 7, "A11": 6}


def make_reads(spark, rows):
    return spark.createDataFrame(rows, READS)


def test_merge_is_commutative_in_counts_and_keeps_totals(spark, tmp_path):
    a = [("x", "AC", None, -3, "..", None, None, [(5, -3, 2), (7, -9, 1)]), ("y", "GG", None, None, None, None, None, [])]
    b = [("x", "AC", None, -1, ".T", 3, 5, [(5, -1, 4)]), ("z", "TT", "!!", -2, "..", None, None, [(1, -2, 1)])]
    one = {r.name: r for r in reads.merged(make_reads(spark, a), make_reads(spark, b)).collect()}
    two = {r.name: r for r in reads.merged(make_reads(spark, b), make_reads(spark, a)).collect()}
    assert set(one) == {"x", "y", "z"} and all(one[k].tax == two[k].tax and one[k].mline == two[k].mline for k in one)
    assert [tuple(t) for t in one["x"].tax] == [(5, -1, 6), (7, -9, 1)] and one["x"].max_score == -1 and one["x"].mline == ".T"
    assert one["x"].lca is None and one["y"].tax == []


def test_merge_of_bucketed_tables(spark):
    """A union of two tables bucketed by the key must still bring the same names together."""
    for i in (1, 2):
        spark.range(1000).select(F.format_string("r%d", "id").alias("name"), F.lit(i).alias("v")).write.mode("overwrite").bucketBy(4, "name").saveAsTable(f"bucketed_{i}")
    try:
        both = spark.table("bucketed_1").unionByName(spark.table("bucketed_2")).groupBy("name").count()
        assert both.count() == 1000
    finally:
        for i in (1, 2):
            spark.sql(f"drop table bucketed_{i}")


def test_build_from_alignments(spark):
    rows = [
        ("q1", 0, "ACGTN", "abcde", "5M", "2A2", -3, 7, 1), ("q1", 16, "NACGT", "edcba", "5M", "5", -1, 8, 2), ("q1", 0, "ACGTN", "abcde", "5M", "5", -1, 8, 3),
        ("q2", 16, "AAC", "abc", None, None, None, 0, 4), ("q3", 64, "A", "a", "1M", "1", -5, 7, 5), ("q3", 128, "C", "c", "1M", "1", -4, 7, 6),
    ]
    df = spark.createDataFrame(rows, "qname string, flag int, seq string, qual string, cigar string, md string, score int, taxid int, ord long")
    got = {r.name: r for r in reads.build(df).collect()}
    assert (got["q1"].seq, got["q1"].max_score, got["q1"].mline, [tuple(t) for t in got["q1"].tax]) == ("ACGTN", -1, ".....", [(7, -3, 1), (8, -1, 2)])
    assert (got["q2"].seq, got["q2"].qual, got["q2"].max_score, got["q2"].mline, [tuple(t) for t in got["q2"].tax]) == ("GTT", "cba", None, None, [(0, -16384, 1)])
    assert got["q3"].seq == "A" and got["q3"].tax[0].cnt == 2
    assert {r.name for r in reads.build(df, mates_apart=True).collect()} == {"q1", "q2", "q3/1", "q3/2"}


def test_lca_options(spark):
    rows = [("a", "ACGT", None, -1, "....", None, None, [(6, -1, 1), (7, -9, 1)]), ("b", "ACGT", None, -1, "TTTT", None, None, [(6, -1, 1)]), ("c", "ACGT", None, None, None, None, None, [])]
    df = make_reads(spark, rows)
    assert {r.name: r.lca for r in reads.with_lca(df, nodes(spark)).collect()} == {"a": 3, "b": 6, "c": None}
    assert {r.name: r.lca for r in reads.with_lca(df, nodes(spark), score_threshold=5).collect()} == {"a": 6, "b": 6, "c": None}
    assert {r.name: r.lca for r in reads.with_lca(df, nodes(spark), max_divergence=0.5).collect()} == {"a": 3, "b": None, "c": None}
    with_lca = reads.with_lca(df, nodes(spark))
    assert [r.name for r in reads.below(with_lca, nodes(spark), 4).collect()] == ["b"]


def test_short_reads_count_from_the_start(spark):
    df = make_reads(spark, [("a", "cg", None, -1, "..", None, None, []), ("b", "t" * 40, None, -1, "C" + "." * 39, None, None, [])])
    got = {(r.zone, r.pos, r.ref, r.base): r.n for r in reports.substitutions(df).collect()}
    assert got[("start", 1, "C", "C")] == 1 and got[("start", 2, "G", "G")] == 1 and got[("start", 1, "C", "T")] == 1 and got[("mid", 0, "T", "T")] == 10 and got[("end", 1, "T", "T")] == 1


def test_lengths(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int")
    r = reports.lengths(df, F.col("n")).first()
    assert (r.n, r.min_len, r.max_len, r.mean_len, r.tot_len, r.n50) == (4, 1, 10, 4.0, 16, 10)


def test_sorted_by_name(spark):
    random.seed(4)
    df = spark.createDataFrame([("".join(random.choice("abAB1_") for _ in range(4)), "f", i) for i in range(500)], "qname string, file string, ord long")
    out = sorting.by_name(df, df)
    assert out.count() == 1000 and sorting.in_order(out).first().disordered == 0
    names = [r.qname for r in out.collect()]
    assert names == sorted(names, key=str.encode)


def test_slices(spark):
    got = sorting.slices(spark.range(30).withColumnRenamed("id", "row_id"), [(0, None), (5, 8)]).collect()
    assert [r.row_id for r in got] == [0, 5, 6, 7]


def test_a_coded_tree_of_many_shapes(spark):
    rng = random.Random(8)
    t = lambda i: 10 * (i + 1)
    parents = {i: i if i < 3 else rng.choice([max(0, i - 1), rng.randrange(i), rng.randrange(min(i, 4))]) for i in range(160)}  # three trees: chains, bushes, nodes with very many below
    ranks = {i: rng.choice(["genus", "family", "x", "y"]) for i in parents}
    nodes = spark.createDataFrame([(t(i), t(p), ranks[i], f"n{i}") for i, p in parents.items()], "taxid int, parent int, rank string, name string")
    tree = taxonomy.coded(nodes)

    def ups(i):
        return [i] if parents[i] == i else [i, *ups(parents[i])]

    assert {(r.taxid, r.ancestor, r.depth) for r in taxonomy.lineage(tree).collect()} == {(t(i), t(a), len(ups(a)) - 1) for i in parents for a in ups(i)}
    assert {r.taxid: r.at_rank for r in taxonomy.at_rank(tree, "family").collect()} == {t(i): next((t(a) for a in ups(i) if ranks[a] == "family"), 0) for i in parents}
    for root in (0, 1, 5, 99):
        assert {r.taxid for r in taxonomy.subtree(tree, t(root)).collect()} == {t(i) for i in parents if root in ups(i)}
    sets = {f"k{k}": rng.sample(range(160), rng.randrange(1, 5)) for k in range(200)}

    def common(some):
        shared = [a for a in ups(some[0]) if all(a in ups(i) for i in some)]
        return t(shared[0]) if shared else None

    taxa = spark.createDataFrame([(k, t(i)) for k, some in sets.items() for i in some], "name string, taxid int")
    assert {r.name: r.lca for r in taxonomy.lca(taxa, tree).collect()} == {k: common(some) for k, some in sets.items()}
    some = spark.createDataFrame([(t(150),), (t(77),), (7,), (0,)], "taxid int").where("taxid <> 0")
    part = taxonomy.closure(some, tree)
    assert {r.taxid for r in part.collect()} == {t(a) for i in (150, 77) for a in ups(i)}
    assert {r.taxid: r.at_rank for r in taxonomy.at_rank(part, "genus").collect()} == {t(i): next((t(a) for a in ups(i) if ranks[a] == "genus"), 0) for i in {a for i in (150, 77) for a in ups(i)}}
    for df in (taxonomy.at_rank(tree, "family"), taxonomy.annotated(tree), taxonomy.subtree(tree, 50), taxonomy.closure(some, tree), taxonomy.lca(taxa, tree)):
        plan = df._jdf.queryExecution().toString()
        assert "path" not in plan and "array_contains" not in plan and "posexplode" not in plan
    assert taxonomy.coded(nodes.limit(0)).count() == 0 and taxonomy.at_rank(nodes.limit(0), "x").count() == 0
