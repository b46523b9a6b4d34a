"""What only larger inputs showed: keys that outgrow their digits, pieces without a group, parts and memory that didn't follow the input."""

import time

import duckdb
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from readlake.functions import flat
from readlake.functions import sequences as S
from readlake.operators import reads, scaffolds
from readlake.plans import registry
from readlake.session import parts
from readlake.sources import bam, container, one
from readlake.streaming import incremental


def test_accessions_beyond_six_digits(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table supplier as select cast(unnest([1, 3, 5]) as bigint) as s_suppkey")
    con.execute("create table part as select cast(unnest([1, 100000, 100001, 999999, 1000000, 1000011, 1200005]) as bigint) as p_partkey")
    for t in ("supplier", "part"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = sorted(con.execute(registry.oracle_sql()["joi1_accession_taxa"]).fetchall())
    assert sorted((r.accession, r.taxid) for r in registry.queries()["joi1_accession_taxa"](spark, str(tmp_path)).collect()) == want


def test_long_objects_of_groups(spark, tmp_path):
    head = ["1 3 abc 2 1", "~ O G 1 6 STRING", "~ G S 0", "~ O S 1 3 INT", "~ D I 1 6 STRING"]
    many = "".join(f"I 5 {i:05d}\n" for i in range(40_000))
    (tmp_path / "a").write_text("\n".join(head) + "\n" + "".join(f"G 1 {g}\n" + f"S {i}\n{many}S {10 + i}\n" for i, g in enumerate("xyz")))
    begun = time.time()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # blocks without a group line, and such as begin within an object
    try:
        got = sorted((r.S.f0, r.group.f0, len(r.I)) for r in container.objects(spark, str(tmp_path / "a")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, "x", 40_000), (1, "y", 40_000), (2, "z", 40_000), (10, "x", 0), (11, "y", 0), (12, "z", 0)]
    assert time.time() - begun < 20


def test_a_header_of_many_parts_is_read_once(spark, tmp_path, monkeypatch):
    """Names of references that take more than a file's first bytes, in parts that are as many as their rows ask for."""
    import base64
    import random

    rng, path = random.Random(3), str(tmp_path / "a.bam")
    names = [base64.b32encode(rng.randbytes(10)).decode() for _ in range(8000)]
    lines = [(f"r{i}\t0\t{names[i]}\t{i + 1}\t9\t3M\t*\t0\t0\tACg\tABC\tXA:i:{i}",) for i in range(40)]
    rows = spark.createDataFrame(lines, "value string")
    n = parts(rows, 3, 10)
    assert (n, parts(rows, 5, 10)) == (4, 5)
    bam.write_lines(rows.repartition(n), path, spark.createDataFrame([(f"@SQ\tSN:{x}\tLN:1000",) for x in names], "value string"))
    calls, real = [], bam.header
    monkeypatch.setattr(bam, "header", lambda f: calls.append(1) or real(f))
    ranges = bam.BamReader(path, 1 << 20, False).partitions()
    assert (len(ranges), len(calls), {r.n_refs for r in ranges}) == (4, 1, {8000})
    monkeypatch.undo()
    got = bam.alignments(spark, path).collect()
    assert sorted((r.qname, r.rname, r.seq, r.qual, r.aux["XA"]) for r in got) == sorted((f"r{i}", names[i], "ACG", "ABC", str(i)) for i in range(40))


def test_a_large_bucket_is_folded_into_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "parts", lambda df, least: parts(df, least, 50), raising=False)
    rows = spark.range(400).selectExpr("concat('r', id % 150) as qname", "cast(id % 3 as int) as taxid", "cast(-id as int) as score")
    source, path = str(tmp_path / "source"), str(tmp_path / "taxa")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema("qname string, taxid int, score int").option("maxFilesPerTrigger", 1).parquet(source)
    incremental.ingest(stream, path, str(tmp_path / "checkpoint"), every=2, buckets=2).awaitTermination()
    files = list((tmp_path / "taxa").glob("_fold=3/bucket=*/*.parquet"))
    assert len(files) > 2 and incremental.folded(spark, path)["buckets"] == 2
    assert sorted(map(tuple, incremental.current_taxa(spark, path).collect())) == sorted(map(tuple, reads.taxa_of(rows).collect()))


def test_dust_takes_a_batch_in_stretches(spark, monkeypatch):
    from readlake.functions import flat, sequences

    column = pa.array(["acgt" * 30, None, "", "a" * 500, "acgtn" * 90, "ca" * 70] * 5)
    want = np.floor(0.5 + flat.dust_scores(flat.Flat(column))).astype(int).tolist()
    most, real = [], flat.dust_scores
    monkeypatch.setattr(sequences, "DUST", 600, raising=False)
    monkeypatch.setattr(flat, "dust_scores", lambda x: most.append(len(x.data)) or real(x))
    got = sequences.dust.func(column)
    assert got.to_pylist() == [None if x is None else w for x, w in zip(column.to_pylist(), want, strict=True)]
    assert max(most) < 600 + 500
    assert sequences.dust.func(pa.array([], pa.string())).to_pylist() == []


ODD = ["", "n", "nn", "acgt", "nACGTnnnACnnGTn", "aénn𝄞𝄞c", "éé", "UuTtRRy-*"]


def brute_exceptions(seq):
    out = []
    for i, c in enumerate(seq):
        if c not in "ACGTacgt":
            if out and out[-1][1] == c and out[-1][0] + out[-1][2] == i:
                out[-1] = (out[-1][0], c, out[-1][2] + 1)
            else:
                out.append((i, c, 1))
    return out


def test_reads_of_many_exceptions_in_a_container(spark, tmp_path):
    """Each exception copied the whole sequence when it was put back."""
    long = "acgtn" * 60_000
    rows = [(f"r{i}", s, "q", 3 - i, "..", None, 7, [(5, -1, 2)]) for i, s in enumerate([*ODD, long])]
    df = spark.createDataFrame(rows, "name string, seq string, qual string, max_score int, mline string, dust int, lca int, tax array<struct<taxid:int,best_score:int,cnt:bigint>>")
    begun = time.time()
    one.write_reads(df.repartition(3), str(tmp_path / "a"))
    got = {r.name: (r.name, r.seq, r.qual, r.max_score, r.mline, r.dust, r.lca, [tuple(t) for t in r.tax]) for r in one.reads(spark, str(tmp_path / "a")).collect()}
    assert [got[r[0]] for r in rows] == [(r[0], "".join(c.lower() if c in "ACGT" else c for c in r[1]), *r[2:]) for r in rows]
    assert time.time() - begun < 30
    (tmp_path / "b").write_text("1 3 seq 2 1\nS 4 acgt\nI 1 x\nN 1 n 2\nN 2 R 3\nL 9\nS 4 acgt\nN q n 1\nI 1 y\nS 9 acgt\nI 1 z")
    assert sorted((r.name, r.seq, r.lca) for r in one.reads(spark, str(tmp_path / "b")).collect()) == [("x", "anRRR", 9), ("y", None, None), ("z", "acgt", None)]


def test_exceptions_of_long_sequences(spark):
    long = "an" * 150_000
    begun = time.time()
    df = spark.createDataFrame([(s,) for s in [*ODD, long, None]], "s string")
    plain = F.regexp_replace("s", "[^ACGTacgt]", "a")
    for r in df.select("s", S.exceptions("s").alias("e"), S.overlaid(plain, S.exceptions("s")).alias("back")).collect():
        assert r.back == r.s and (r.e if r.s is None else [tuple(e) for e in r.e]) == (None if r.s is None else brute_exceptions(r.s))
    assert time.time() - begun < 20
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("base", pa.string()), ("run", pa.int32())]))
    runs = [[(1, "n", 2), (2, "r", 1)], [(2, "é", 1), (4, "n", 3)], [(0, "n", None)], None, []]
    found = pa.array([None if r is None else [dict(zip(("pos", "base", "run"), x, strict=True)) for x in r] for r in runs], kind)
    assert flat.overlaid(pa.array(["acgt"] * 5), found).to_pylist() == ["anrt", "acétnnn", None, None, "acgt"]
    assert flat.overlaid(pa.array(["acgt"] * 5).slice(1), found.slice(1)).to_pylist() == ["acétnnn", None, None, "acgt"]


def test_long_scaffolds_of_many_contigs(spark):
    """Each contig's row held the whole scaffold, and its place was a sum over all contigs before it."""
    begun, long = time.time(), "nn" + "acgtnnn" * 20_000
    seqs = [*ODD, long, "nnnn"]
    rows = [(f"s{i}", None, s, q) for i, s in enumerate(seqs) for q in [None if i % 3 == 2 else "".join(chr(35 + j % 50) for j in range(len(s)))]]
    df = spark.createDataFrame(rows, "id string, description string, seq string, qual string")
    parts_ = scaffolds.broken(df, 2)
    back = {r.id: r for r in scaffolds.joined(parts_).collect()}
    for name, _, seq, qual in rows:
        here, q = brute_joined(seq, qual, 2)
        assert (back[name].seq, back[name].qual) == (here, q)
    assert time.time() - begun < 30


def brute_joined(seq, qual, gap):
    """seq with n, and qual with !, in the runs of at least gap letters other than A, C, G, T, and at both ends."""
    import re

    seq, qual = list(seq), None if qual is None else list(qual)
    for m in re.finditer("[^ACGTacgt]+", "".join(seq)):
        if m.end() - m.start() >= gap or m.start() == 0 or m.end() == len(seq):
            for i in range(*m.span()):
                seq[i] = "n"
                if qual is not None:
                    qual[i] = "!"
    return "".join(seq), None if qual is None else "".join(qual)


def test_sequences_of_the_fixture(spark, tmp_path):
    """Letters passed lambdas of SQL one by one; what they made is the same for texts beyond ASCII, nulls, and a long one."""
    from readlake.plans import fixtures

    con, texts = duckdb.connect(), [None, "", "xyz", "Ā ﾅ é", "Änne CATG nag", "tacKİgn 𝄞 ANT", "the cat gnats " * 20_000]
    spark.createDataFrame([(i * 13 + 4, s) for i, s in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(7).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    for x in ("documents", "supplier"):
        con.execute(f"create table {x} as select * from '{tmp_path}/{x}.parquet/*.parquet'")
    want = con.execute("with " + fixtures.SQL_SEQUENCES + ", ed as (select doc_id, string_agg(edit, '' order by i) as m, string_agg(chr(cast(33 + q as integer)), '' order by i) as q from letters group by doc_id) select name, doc_id, seq, m, q, max_score, lca from seqs join ed using (doc_id)").fetchall()
    begun = time.time()
    assert sorted(map(tuple, fixtures.sequences(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 3
    plan = fixtures.sequences(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan
    assert time.time() - begun < 20


def test_reads_are_built_in_one_exchange_and_one_sort(spark):
    """Alignments were dealt by name and taxon, their partial results once more by name."""
    columns = ("concat('r', id % 40) as qname", "0 as flag", "concat('AC', id) as seq", "'II' as qual", "'2M' as cigar", "'2' as md", "cast(if(id % 3 = 0, null, id % 7) as int) as score", "cast(id % 5 as int) as taxid", "id as ord")
    rows = reads.build(spark.range(400).selectExpr(*columns))
    plan = rows.drop("tax")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort [")) == (1, 1)
    got = {r.name: r for r in rows.collect()}
    for k in range(40):
        mine = [i for i in range(400) if i % 40 == k]
        assert got[f"r{k}"].seq == f"AC{k}" and got[f"r{k}"].max_score == max(i % 7 for i in mine if i % 3)
        assert {(t.taxid, t.cnt) for t in got[f"r{k}"].tax} == {(x, sum(i % 5 == x for i in mine)) for x in {i % 5 for i in mine}}


def test_what_reads_have_runs_nothing_else(spark, sf, monkeypatch):
    """The report's other tables were worked out and checkpointed too, so reads were built twice."""
    from readlake.operators import reports

    monkeypatch.setattr(reports, "cut", lambda df: 1 / 0)
    assert registry.queries()["agg17_what_reads_have"](spark, sf).first().n_reads > 0
