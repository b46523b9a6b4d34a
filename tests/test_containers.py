import random
import struct
import zlib

from pyspark.sql import functions as F

from readlake.operators import reads
from readlake.schemas import READS
from readlake.sources import bam, one, sinks, text
from readlake.streaming.incremental import running_taxa

ROWS = [("r1", "acgtn", "IIII!", -3, "..A.-", 12, 7, [(5, -3, 2), (7, -9, 1)]), ("r2", "nnacry", None, None, None, None, None, []), ("r3", "a", "S", 0, ".", 0, None, [(1, 0, 1)])]


def test_reads_through_text(spark, tmp_path):
    df = spark.createDataFrame(ROWS, READS)
    path = str(tmp_path / "r")
    one.write_reads(df.repartition(2), path)
    got = {r.name: r for r in one.reads(spark, path).collect()}
    want = {r.name: r for r in df.collect()}
    assert got == want
    (tmp_path / "p.1read").write_text("1 3 seq 2 1\n2 4 read\nP 2 xy\nS 4 acat\nI 1 z\nN 2 n 1\nT 3 -1 9\n")
    r = one.reads(spark, str(tmp_path / "p.1read")).first()
    assert (r.name, r.seq, [tuple(t) for t in r.tax]) == ("xyz", "acnt", [(3, -1, 9)])


def test_intervals_of_text(spark, tmp_path):
    (tmp_path / "a").write_text("1 6 acctax 2 1\nA 9 1 2 0 2 AB\nA 8 3 1 2 0 \nA 7 1 4 1 3 CDE\nA 6 2 2 3 1 X\n")
    got = [tuple(r) for r in one.intervals(spark, str(tmp_path / "a")).orderBy("taxid").collect()]
    assert got == [("ACDX", 2, 2, 6), ("ACDE", 1, 4, 7), ("AB", 3, 1, 8), ("AB", 1, 2, 9)]


def bgzf(data, size):
    out = b""
    for i in range(0, len(data) + 1, size):
        part = data[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += bam.MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, flag, ref, pos, ops, seq, qual, aux):
    packed = bytes(bam.BASES.index(a) << 4 | bam.BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + aux
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"@SQ\tSN:r1\tLN:100\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 2) + struct.pack("<i", 3) + b"r1\0" + struct.pack("<i", 100) + struct.pack("<i", 3) + b"r2\0" + struct.pack("<i", 50)
    n = 3000
    for i in range(n):
        data += record(f"q{i:05d}", 16 * (i % 2), i % 2, i, [4 << 4, 1 << 4 | 4], "ACGTN", bytes([30, 31, 32, 33, 34]) if i % 3 else b"\xff" * 5, b"ASc" + struct.pack("<b", -(i % 100)) + b"MDZ4\0" + b"XBBS" + struct.pack("<iHH", 2, 7, i))
    path = tmp_path / "a.bam"
    path.write_bytes(bgzf(data, 5000))
    bam.register(spark)
    for split in (1 << 26, 7000, 2500):
        got = spark.read.format("bam").option("split", split).load(str(path)).orderBy("ord").collect()
        assert [r.qname for r in got] == [f"q{i:05d}" for i in range(n)]
    r = got[7]
    assert (r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.score, r.md, r.aux["XB"]) == (16, "r2", 8, "4M1S", "ACGTN", "?@ABC", -7, "4", "S,7,7") and got[3].qual is None


def test_bam_to_sam_and_back(spark, tmp_path):
    lines = ["@HD\tVN:1.6\tSO:queryname", *(f"@SQ\tSN:r{i}\tLN:{1000 + i}" for i in range(6000)), "@RG\tID:g\tSM:s", "@PG\tID:p", "@CO\tfree\ttext"]
    rng = random.Random(8)
    for i in range(400):
        n = rng.choice([1, 7, 90])
        lines.append(f"q{i:04d}\t{rng.choice([0, 16])}\tr{rng.randrange(6000)}\t{1 + rng.randrange(900)}\t{rng.randrange(60)}\t{n}M\t{rng.choice(['*', '=', 'r7'])}\t{rng.randrange(50)}\t{rng.randrange(-50, 50)}\t{''.join(rng.choices('ACGTN', k=n))}\t{''.join(rng.choices('!5IJ', k=n))}\tAS:i:{rng.choice([-300, -3, 0, 200, 70000])}\tMD:Z:{n}")
    lines.append("q9999\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*")
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    rows, heads = text.sam(spark, str(tmp_path / "a.sam")), text.sam_headers(spark, str(tmp_path / "a.sam"))
    bam.write(rows.repartition(3, "qname"), str(tmp_path / "out"), sinks.header_lines(heads.orderBy("ord")))
    parts = sorted(str(p) for p in (tmp_path / "out").glob("part-*.bam"))
    assert len(parts) == 3 and not list((tmp_path / "out").glob("_attempt*"))
    got = [r.value for p in parts for r in sinks.sam_lines(spark.read.format("bam").load(p)).collect()]
    assert sorted(got) == sorted(r.value for r in sinks.sam_lines(rows).collect()) and len(got) == 401
    for p in parts:
        assert [r.value for r in sinks.header_lines(bam.headers(spark, p).orderBy("ord")).collect()] == [r.value for r in sinks.header_lines(heads.orderBy("ord")).collect()]


def test_bam_of_long_records(tmp_path):
    rng = random.Random(3)
    data = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 3) + b"r1\0" + struct.pack("<i", 100)
    sizes = [rng.choice([5, 30000, 120000]) for _ in range(40)]
    for i, n in enumerate(sizes):
        data += record(f"q{i:05d}", 0, 0, i, [n << 4], "".join(rng.choices("ACGT", k=n)), rng.randbytes(n).translate(bytes(b % 40 for b in range(256))), b"")
    path = tmp_path / "long.bam"
    path.write_bytes(bgzf(data, 20000))  # a record of 120,000 bases lies in ten blocks
    for split in (1 << 26, 100_000, 20_000):
        reader = bam.BamReader(str(path), split)
        got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert [(r["qname"], len(r["seq"])) for r in got] == [(f"q{i:05d}", n) for i, n in enumerate(sizes)]


def test_running_taxa_equal_those_at_once(spark, tmp_path):
    df = spark.range(300).select(F.format_string("q%d", F.col("id") % 20).alias("qname"), (F.col("id") % 3).cast("int").alias("taxid"), (-(F.col("id") % 7)).cast("int").alias("score"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running_taxa(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("running").collect()} == {tuple(r) for r in reads.taxa_of(df).collect()}


def test_names_of_very_many_references(spark, tmp_path, monkeypatch):
    lines = [*(f"@SQ\tSN:r{i}\tLN:9" for i in range(300)), *(f"q{i}\t0\tr{i % 7}\t1\t9\t1M\t{'=' if i % 2 else 'r299'}\t3\t0\tA\tI\tXX:Z:a b\tXF:f:0.5\tXA:A:c\tXC:B:c,-1,2\tXI:B:f,1.5" for i in range(60))]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    rows = text.sam(spark, str(tmp_path / "a.sam"))
    for k in range(2):  # parts under two headers in one folder
        bam.write(rows.where(F.col("pos") == 1).coalesce(1), str(tmp_path / f"{k}.bam"), spark.sql(f"select '@CO\ta{k}' as value").unionByName(spark.read.text(str(tmp_path / "a.sam")).where("value like '@%'")))
    (tmp_path / "both.bam").mkdir()
    for k in range(2):
        (tmp_path / f"{k}.bam/part-00000.bam").rename(tmp_path / f"both.bam/part-{k}.bam")
    want = sorted(2 * [(r.qname, r.rname, r.rnext, r.aux["XX"], r.aux["XC"]) for r in rows.collect()])
    for most in (bam.MOST_SENT, 3):  # names that occur are looked up, if there are too many to send
        monkeypatch.setattr(bam, "MOST_SENT", most)
        got = bam.alignments(spark, str(tmp_path / "both.bam"), split=400)
        assert sorted((r.qname, r.rname, r.rnext, r.aux["XX"], r.aux["XC"]) for r in got.collect()) == want
    assert got.where("aux['XF'] = '0.5' and aux['XA'] = 'c' and aux['XI'] = 'f,1.5'").count() in (0, 120)
