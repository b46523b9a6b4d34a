"""Blocked gzip in small splits against the unpacked text; ordinary gzip by one task."""

import gzip
import io
import random

import pytest

from readlake.sources import bam, blocked, sinks, text


def packed(data, rng, most):
    out, at = b"", 0
    while at < len(data):
        n = rng.randrange(1, most)
        out, at = out + bam.packed_block(data[at : at + n]), at + n
    return out + bam.EOF_BLOCK


@pytest.mark.parametrize("sep", [b"\n", b"\n@", b"abc"])
def test_pieces_of_every_split(sep):
    rng = random.Random(len(sep))
    for k in range(60):
        data = b"".join(rng.choice([b"a", b"b", b"c", b"@", b"\n", b"abc", b"\n@", b"x" * 40]) for _ in range(rng.randrange(0, 300)))
        file = packed(data, rng, rng.choice([3, 20, 400]))
        want = data.split(sep)
        want = want[:-1] if not want[-1] else want
        for size in (1 << 20, 61, 200):
            got = []
            for a in range(0, len(file), size):
                f = io.BytesIO(file)
                f.size = lambda n=len(file): n
                got += [p for some in blocked.cut(f, a, min(a + size, len(file)), sep) for p in some]
            assert got == want, (k, size)


def rows(df):
    return sorted(map(str, df.drop("ord", "file").collect()))


def test_formats(spark, tmp_path):
    rng = random.Random(1)
    acc = "accession\taccession.version\ttaxid\n" + "".join(f"AB{i:05d}\tAB{i:05d}.1\t{i // 9}\n" for i in range(4000))
    sam = "@SQ\tSN:r1\tLN:9\n" + "".join(f"q{i}\t0\tr1\t{1 + i % 8}\t9\t4M\t*\t0\t0\tACGT\tI@I>\tAS:i:{-i % 7}\n" for i in range(3000))
    seqs = ["".join(rng.choices("acgtn", k=rng.randrange(1, 90))) for _ in range(1500)]
    fastq = "".join(f"@s{i} d\n{s}\n+\n{''.join(rng.choices('@I+>!', k=len(s)))}\n" for i, s in enumerate(seqs))
    fasta = "".join(f">s{i}\n{s[:40]}\n{s[40:]}\n" for i, s in enumerate(seqs))
    for name, data, read in (("acc.tsv", acc, text.accession_table), ("a.sam", sam, text.sam), ("a.fq", fastq, text.fastq), ("a.fa", fasta, text.fasta)):
        (tmp_path / name).write_text(data)
        (tmp_path / f"{name}.gz").write_bytes(packed(data.encode(), rng, 4000))
        (tmp_path / "plain" / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"plain/{name}.gz").write_bytes(gzip.compress(data.encode()))
        want = rows(read(spark, str(tmp_path / name)))
        got = read(spark, str(tmp_path / f"{name}.gz"), split=5000)
        assert rows(got) == want and len(want) >= 1500
        assert blocked.pieces(spark, str(tmp_path / f"{name}.gz"), split=5000).rdd.getNumPartitions() > 3
        assert rows(read(spark, str(tmp_path / f"plain/{name}.gz"))) == want and not blocked.is_blocked(str(tmp_path / f"plain/{name}.gz"))
    numbers = [r.accession for r in text.accession_table(spark, str(tmp_path / "acc.tsv.gz"), split=5000).orderBy("ord").collect()]
    assert numbers == sorted(numbers)


def test_a_folder_of_parts(spark, tmp_path):
    df = spark.range(5000).selectExpr("concat('s', id) as id", "cast(null as string) as description", "repeat('acgt', 1 + cast(id % 30 as int)) as seq", "repeat('@I+!', 1 + cast(id % 30 as int)) as qual")
    blocked.write(sinks.fastq_lines(df.repartition(3)), str(tmp_path / "out.fq.gz"))
    assert sorted(p.name for p in (tmp_path / "out.fq.gz").glob("*")) == [f"part-0000{i}.gz" for i in range(3)]
    got = text.fastq(spark, str(tmp_path / "out.fq.gz"), split=3000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    for p in (tmp_path / "out.fq.gz").glob("*"):
        assert gzip.decompress(p.read_bytes()).startswith(b"@s")  # any gzip reads it
