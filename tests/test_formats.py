"""Containers of any schema, packed sequences, contigs with memory, folded streams, against what was written."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import reads, scaffolds
from readlake.sources import container, packed
from readlake.streaming import incremental


def test_a_container_of_unknown_lines(spark, tmp_path):
    head = ["1 3 abc 2 1", "2 3 sub", "! 4 4 prog 1 1 3 cmd 4 date", "~ O G 1 6 STRING named group", "~ G S 0", "~ O S 2 3 INT 3 DNA", "~ D I 1 6 STRING", "~ D Q 3 4 CHAR 4 REAL 8 INT_LIST", "~ D W 1 11 STRING_LIST", "# S 3"]
    body = "G 3 g 1\nS 5 4 acgt\nI 7 a b  c \nQ x 1.5 3 1 -2 3\nQ y -0.25 0\n. a comment\nU unknown\nS 6 0 \nG 2 é2\nS 7 2 gg\nW 2 3 d e 0 \n"
    (tmp_path / "a").write_text("\n".join(head) + "\n" + body)
    assert container.head(str(tmp_path / "a")) == head
    want = {(5, "acgt", ("a b  c ",), (("x", 1.5, (1, -2, 3)), ("y", -0.25, ())), (), "g 1"), (6, "", (), (), (), "g 1"), (7, "gg", (), (), (("d e", ""),), "é2")}

    def told(df):
        return {(r.S.f0, r.S.f1, tuple(i.f0 for i in r.I), tuple((q.f0, q.f1, tuple(q.f2)) for q in r.Q), tuple(tuple(w.f0) for w in r.W), r.group.f0) for r in df.collect()}

    rows = container.objects(spark, str(tmp_path / "a"))
    assert told(rows) == want
    container.write(rows.repartition(2), str(tmp_path / "b"), head)
    assert told(container.objects(spark, str(tmp_path / "b"))) == want
    assert container.head(str(tmp_path / "b")) == head[:-1]
    groups = container.objects(spark, str(tmp_path / "a"), "G").collect()
    assert [r.G.f0 for r in groups] == ["g 1", "é2"]
    got = {(r.letter, r.field): (r.actual, r.stored, r.state) for r in container.validated(spark, str(tmp_path / "a")).collect()}
    assert got["S", "count"] == (3, 3, "ok") and got["S", "max"] == (4, None, "missing") and got["W", "total"] == (2, None, "missing") and got["Q", "max"] == (3, None, "missing") and got["U", "count"][2] == "unknown"
    assert [x for x in container.regenerated(spark, str(tmp_path / "a")) if x[0] in "#@+"][:3] == ["# G 2", "@ G 3", "+ G 5"]
    with pytest.raises(ValueError, match="unknown type"):
        container.Schema(["~ O S 1 4 WHAT"])


def test_objects_of_every_split(spark, tmp_path):
    head = "1 3 abc 1 1\n~ O G 1 3 INT\n~ G S 0\n~ O S 1 3 INT\n~ D I 1 6 STRING\n"
    text, want, rng = head, set(), random.Random(4)
    for g in range(40):
        text += f"G {g}\n"
        for i in range(rng.randrange(4)):
            text += f"S {100 * g + i}\nI 5 hello\n"
            want.add((100 * g + i, g))
    (tmp_path / "a").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert {(r.S.f0, r.group.f0) for r in container.objects(spark, str(tmp_path / "a")).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_packed_sequences(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        n = rng.choice([0, 1, 3, 4, 7, 50, 900])
        rows.append((f"id{i}" if i % 50 else None, rng.choice([None, "some words"]), "".join(rng.choices("acgt", k=n)), "".join(rng.choices("!5?I", k=n)) if i % 3 else None))
    df = spark.createDataFrame(rows, "id string, description string, seq string, qual string").withColumn("extra", F.lit(1))
    for threshold in (30, 0):
        path = str(tmp_path / f"t{threshold}")
        packed.write(df.repartition(3), path, threshold)
        one_bit = lambda r: "".join("?" if x in "?I" else "!" for x in r[3] or "!" * len(r[2])) if threshold else None  # noqa: E731, B023
        for split in (1 << 26, 4000, 333):
            got = packed.sequences(spark, path, split).collect()
            assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(*r[:3], one_bit(r)) for r in rows], "id string, description string, seq string, qual string").collect()))
    packed.write(df.limit(0), str(tmp_path / "none"))
    assert packed.sequences(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").write_text("nothing of the kind" * 9)
    with pytest.raises(Exception, match="packed"):
        packed.sequences(spark, str(tmp_path / "bad")).count()


def test_contigs_with_memory(spark):
    rng = random.Random(7)
    rows = [(f"s{i}", rng.choice([None, "told so"]), "".join(rng.choices("acgtnN", weights=[4, 4, 4, 4, 20, 1], k=rng.randrange(60))), None) for i in range(200)] + [("none", None, "nnn", None), ("empty", None, "", None)]
    rows = [(a, b, c, "".join(rng.choices("!5I", k=len(c))) if i % 2 else None) for i, (a, b, c, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, description string, seq string, qual string")
    for gap in (1, 3):
        contigs = scaffolds.broken(df, gap)
        back = {r.id: r for r in scaffolds.joined(contigs.repartition(5)).collect()}
        for id_, text, seq, qual in rows:
            r = back[id_]
            same = [x.lower() in "acgt" for x in seq]
            assert r.description == text and len(r.seq) == len(seq) and all(x == y for x, y, s in zip(r.seq, seq, same, strict=True) if s) and set(r.seq) <= set("acgtnN")
            assert (r.qual is None) == (qual is None) and (qual is None or all(x == y for x, y, s in zip(r.qual, qual, same, strict=True) if s))
    with pytest.raises(Exception, match="lacking"):
        scaffolds.joined(contigs.where("description not like '%part=2/%'")).collect()
    assert [tuple(r) for r in scaffolds.joined(df.where("id = 's1'")).collect()] == [rows[1]]


def test_folded_batches(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(f"q{rng.randrange(30)}", rng.randrange(4), rng.choice([None, -rng.randrange(9)])) for _ in range(40)] for _ in range(6)]
    path, schema = str(tmp_path / "t"), "qname string, taxid int, score int"

    def put(i):
        reads.taxa_of(spark.createDataFrame(batches[i], schema)).write.mode("overwrite").parquet(f"{path}/batch={i}")

    def right(n):
        want = reads.taxa_of(spark.createDataFrame([r for b in batches[:n] for r in b], schema))
        assert sorted(map(tuple, incremental.current_taxa(spark, path).collect())) == sorted(map(tuple, want.collect()))

    for i in range(3):
        put(i)
    incremental.fold(spark, path, 1, buckets=3)
    right(3)
    incremental.fold(spark, path, 1, buckets=3)  # done again: nothing is left to fold
    put(3)
    put(4)
    incremental.fold(spark, path, 4, buckets=99)  # the number of buckets stays
    right(5)
    assert len(list((tmp_path / "t").glob("batch=*"))) == 0 and len(incremental.current_taxa(spark, path).inputFiles()) <= 3
    assert "Exchange" not in incremental.current_taxa(spark, path)._jdf.queryExecution().executedPlan().toString()
    put(5)
    (tmp_path / "t/_fold=5/bucket=0").mkdir(parents=True)  # what a fold that was broken off has left
    (tmp_path / "t/_fold=5/bucket=0/part-0").write_text("broken")
    incremental.fold(spark, path, 5)
    right(6)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    df = spark.range(200).select(F.format_string("q%d", F.col("id") % 20).alias("qname"), (F.col("id") % 3).cast("int").alias("taxid"), (-(F.col("id") % 7)).cast("int").alias("score"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    for checkpoint in ("a", "b"):  # the second run knows of no batch and replays all
        incremental.ingest(stream(), path, str(tmp_path / checkpoint), every=2, buckets=3).awaitTermination(120)
        assert {tuple(r) for r in incremental.current_taxa(spark, path).collect()} == {tuple(r) for r in reads.taxa_of(df).collect()}


def test_a_stream_that_has_brought_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "qname string, taxid int, score int"
    nothing = reads.taxa_of(spark.createDataFrame([], schema))
    for step in ("no batch", "an empty batch", "an empty batch that is folded"):
        if step == "an empty batch":
            nothing.write.parquet(f"{path}/batch=0")
        elif step == "an empty batch that is folded":
            incremental.fold(spark, path, 0)
        got = incremental.current_taxa(spark, path)
        assert got.count() == 0 and [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in nothing.schema], step
    reads.taxa_of(spark.createDataFrame([("q", 1, -2)], schema)).write.parquet(f"{path}/batch=1")
    incremental.fold(spark, path, 1)
    assert [tuple(r) for r in incremental.current_taxa(spark, path).collect()] == [("q", 1, -2, 1)]


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "at timestamp, qname string, taxid int, score int"
    rows = [[("2024-01-01 00:01:00", "a", 1, -3), ("2024-01-01 00:04:00", "a", 1, -1)], [("2024-01-01 00:21:00", "b", 2, None)], [("2024-01-01 00:02:00", "a", 1, 0), ("2024-01-01 00:40:00", "c", 3, -2)], [("2024-01-01 01:30:00", "d", 4, -2)]]
    for i, some in enumerate(rows):
        spark.createDataFrame(some, "at string, qname string, taxid int, score int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    out = []
    for i in range(len(rows)):  # file after file in order of arrival
        for p in (tmp_path / "in" / str(i)).glob("part-*.parquet"):
            (tmp_path / "arrived").mkdir(exist_ok=True)
            p.rename(tmp_path / f"arrived/{i}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "arrived"))
        query = incremental.windowed_taxa(stream, "at", "10 minutes", "5 minutes").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
        query.awaitTermination(120)
    got = {(str(r[0])[11:16], *r[1:]) for r in out}
    assert got == {("00:00", "a", 1, -1, 2), ("00:20", "b", 2, None, 1), ("00:40", "c", 3, -2, 1)}
