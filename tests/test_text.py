import pytest

from readlake.sources import sinks, text


def write(path, lines, end="\n"):
    path.write_text("\n".join(lines) + end)
    return str(path)


def test_accession_table(spark, tmp_path):
    lines = ["accession\taccession.version\ttaxid\tgi", "AB1\tAB1.1\t9", "", " AB2\tAB2.1\t9", "AB3\tAB4.1\t9", "AB5\tAB5.x\t9", "AB6\tAB6.1\tnine", "AB7\tAB7.2\t8\t55", "AB8\tAB8.1\t7"]
    path = write(tmp_path / "a.tsv", lines, end="")
    assert [(r.accession, r.taxid) for r in text.accession_table(spark, path).orderBy("ord").collect()] == [("AB1", 9), ("AB7", 8), ("AB8", 7)]
    assert text.accession_table(spark, path, strict=True).count() == 2


def test_taxonomy_dump(spark, tmp_path):
    nodes = [(1, 1, "no rank", 8), (2, 1, "kingdom", 1), (10, 2, "family", 1), (11, 10, "species", 1)]
    write(tmp_path / "nodes.dmp", ["\t|\t".join([str(t), str(p), r, "", str(d), "1", "1", "1", "2", "1", "1", "0", ""]) + "\t|" for t, p, r, d in nodes])
    names = [(1, "root", "", "scientific name"), (2, "Bacteria", "Bacteria <bacteria>", "scientific name"), (2, "eubacteria", "", "synonym"), (10, "Fam", "", "scientific name"), (11, "sp", "", "scientific name")]
    write(tmp_path / "names.dmp", ["\t|\t".join([str(t), *x]) + "\t|" for t, *x in names])
    write(tmp_path / "division.dmp", ["1\t|\tBCT\t|\tBacteria\t|\t\t|", "8\t|\tUNA\t|\tUnassigned\t|\t\t|"])
    got = {r.taxid: r for r in text.taxonomy_dump(spark, str(tmp_path), divisions=True).collect()}
    assert (got[11].family, got[11].grp, got[11].division, got[11].mito_code) == (10, "bacteria", "Bacteria", 2) and got[1].grp is None


SAM = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:r1\tLN:100", "@CO\ta\tb", "q1\t0\tr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:-3\tMD:Z:4", "q2\t0\trX\t5\t60\t4M\t*\t0\t0\tACGT\t*", "q3\t0\tr1\t0\t60\t4M\t*\t0\t0\tACGT\tIIII", "q4\t0\tr1\t7\t60\t3M\t*\t0\t0\tACGT\tIIII", "q5\t16\tr1\t7\t60\t4S\t=\t9\t-3\tACGT\tIIII\tCG:B:I,x"]


def test_sam(spark, tmp_path):
    path = write(tmp_path / "a.sam", SAM)
    got = {r.qname: r for r in text.sam(spark, path).collect()}
    assert (got["q1"].flag, got["q1"].score, got["q1"].md, got["q1"].rname) == (0, -3, "4", "r1")
    assert (got["q2"].flag, got["q2"].rname, got["q2"].qual) == (4, None, None)
    assert got["q3"].flag == 4 and got["q4"].flag == 4 and got["q4"].cigar is None
    kinds = {r.kind: r.tags for r in text.sam_headers(spark, path).collect()}
    assert kinds["@CO"] == {"text": "a\tb"} and kinds["@SQ"] == {"SN": "r1", "LN": "100"}
    lines = [r.value for r in sinks.sam_lines(text.sam(spark, path).where("qname = 'q1'")).collect()]
    assert lines == [SAM[3]]
    assert [r.value for r in sinks.header_lines(text.sam_headers(spark, path).orderBy("ord")).collect()] == ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:r1\tLN:100", "@CO\ta\tb"]


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", [">s1 some text ", "ACgt", "N-*1A", ">s2", "", ">s3\tx", "A"])
    got = [tuple(r)[:3] for r in text.fasta(spark, path).collect()]
    assert got == [("s1", "some text", "ACgtN-A"), ("s2", None, ""), ("s3", "x", "A")]
    lines = sinks.fasta_lines(text.fasta(spark, path)).collect()
    assert lines[0].value == ">s1 some text\nACgtN-A"


def test_fastq(spark, tmp_path):
    records = [("r1 d", "ACGT", "@@II"), ("r2", "AC", "@+"), ("@r3", "A", "@"), ("r4", "ACG", "+@!")]
    path = write(tmp_path / "a.fq", [x for n, s, q in records for x in (f"@{n}", s, "+", q)])
    got = sorted(tuple(r) for r in text.fastq(spark, path).collect())
    assert got == sorted([("r1", "d", "ACGT", "@@II"), ("r2", None, "AC", "@+"), ("@r3", None, "A", "@"), ("r4", None, "ACG", "+@!")])
    out = sinks.fastq_lines(text.fastq(spark, path).where("id = 'r2'")).first().value
    assert out == "@r2\nAC\n+\n@+"
    with pytest.raises(Exception, match="not a FASTQ record"):
        text.fastq(spark, write(tmp_path / "b.fq", ["@r1", "ACGT", "+", "II"])).collect()


def test_names_and_kinds(spark, tmp_path):
    assert sinks.derived("/x.y/a.tsv.gz", "1acctax") == "/x.y/a.1acctax" and sinks.derived("a", "b") == "a.b"
    assert [text.kind_of(s) for s in (">a", "@r", "@HD\tx", "1 3", "b", "\x1f")] == ["fasta", "fastq", "sam", "one", "packed", "bam"]
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    sinks.rewritten(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_default_ids_follow_the_files(spark, tmp_path):
    seqs = ["ACGT"[i % 4] * 3 + format(i, "09b").replace("0", "A").replace("1", "C") for i in range(300)]
    ids = ["" if i % 3 else f"s{i}" for i in range(300)]
    for form, read in (("fasta", text.fasta), ("fastq", text.fastq)):
        lines = [f">{k}\n{s}" if form == "fasta" else f"@{k}\n{s}\n+\n{'@' * len(s)}" for k, s in zip(ids, seqs, strict=True)]
        folder = tmp_path / form
        folder.mkdir()
        for i in range(2):
            (folder / f"{i}.txt").write_text("\n".join(lines[150 * i : 150 * (i + 1)]) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        try:
            rows = read(spark, str(folder), placed=True)
            got = {r.seq: r.id for r in sinks.named(rows, *text.PLACE).collect()}
            assert read(spark, str(folder)).columns == ["id", "description", "seq", "qual"] == sinks.named(rows, *text.PLACE).columns
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {s: k or str(i + 1) for i, (k, s) in enumerate(zip(ids, seqs, strict=True))}
    given = rows.where("id <> ''")
    assert sorted(r.id for r in sinks.named(given, *text.PLACE).collect()) == sorted(k for k in ids if k) and sinks.named(rows.limit(0), *text.PLACE).count() == 0
