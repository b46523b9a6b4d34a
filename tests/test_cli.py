"""Every command on files, from alignments to reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from readlake import cli
from readlake.sources import one, sinks, text

ACC = [("AB", range(1, 60), 11), ("CD", range(5, 40), 12)]
NODES = [(1, 1, "no rank"), (2, 1, "kingdom"), (10, 2, "family"), (11, 10, "species"), (12, 10, "species")]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    rng = random.Random(2)
    (at / "acc.tsv").write_text("accession\taccession.version\ttaxid\n" + "".join(f"{p}{n:04d}\t{p}{n:04d}.1\t{t}\n" for p, some, t in ACC for n in some))
    (at / "tax").mkdir()
    (at / "tax/nodes.dmp").write_text("".join("\t|\t".join([str(t), str(p), r, "", "0", "1", "1", "1", "0", "1", "1", "0", ""]) + "\t|\n" for t, p, r in NODES))
    (at / "tax/names.dmp").write_text("".join(f"{t}\t|\tname{t}\t|\t\t|\tscientific name\t|\n" for t, _, _ in NODES))
    refs = [f"{p}{n:04d}.1" for p, some, _ in ACC for n in some]
    for f in "ab":
        lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{r}\tLN:5000" for r in refs), f"@PG\tID:map\tPN:{f}"]
        for i in range(120):
            seq = "".join(rng.choices("ACGT", k=50))
            for _ in range(rng.randrange(1, 4)):
                lines.append(f"r{i:03d}{f}\t{rng.choice(['0', '16', '0x10'])}\t{rng.choice(refs)}\t{rng.randrange(1, 4000)}\t40\t50M\t*\t0\t0\t{seq}\t{'I' * 50}\tAS:i:{-rng.randrange(20)}\tMD:Z:{rng.choice(['50', '10A39', '0C49'])}\tXB:B:S,1,2\tXH:H:1F")
        (at / f"{f}.sam").write_text("\n".join(lines) + "\n")
    return at


def run(files, *args):
    cli.main([str(files / a[1:]) if a.startswith("/") and not a.startswith(str(files)) else a for a in args])


def test_from_alignments_to_reports(spark, files, capsys):
    run(files, "makeAccTax", "/acc.tsv")
    assert spark.read.parquet(str(files / "acc.1acctax")).count() == 2
    for f in "ab":
        run(files, "bam21read", "/acc.1acctax", f"/{f}.sam")
    run(files, "merge1read", "/a.1read", "/b.1read", "-o", "/m.1read")
    assert spark.read.parquet(str(files / "m.1read")).count() == 240
    run(files, "addLCA", "/tax", "/m.1read", "-o", "/l.1read")
    lca = {r.lca for r in spark.read.parquet(str(files / "l.1read")).collect()}
    assert lca == {10, 11, 12}
    assert {r.taxid for r in spark.read.parquet(str(files / "l.1read.1tax")).collect()} == {1, 2, 10, 11, 12}
    run(files, "reportLCA", "/tax", "/l.1read", "--rank", "family")
    told = spark.read.csv(str(files / "l.reportLCA"), sep="\t", header=True).collect()
    assert [(r["#tax_id"], r["count"]) for r in told] == [("10", "240")]
    run(files, "reportLCA", "/l.1read.1tax", "/l.1read", "-o", "/of_subset")
    run(files, "extractReads", "/tax", "/l.1read", "--lca", "11")
    n = spark.read.parquet(str(files / "l.11.1read")).count()
    assert 0 < n == spark.read.parquet(str(files / "l.1read")).where("lca = 11").count()
    run(files, "report1read", "/l.1read")
    lines = [r.value for r in spark.read.text(str(files / "l.report1read/REPORT")).collect()]
    assert lines[:3] == ["READS", "n_reads\tn_qualities\tn_match_lines\tmin_score\tmax_score", lines[2]] and lines[2].startswith("240\t240\t240\t")
    assert {"LENGTHS", "SCORES", "EDITS", "DAMAGE", "COUNTS"} <= set(lines)
    about = sinks.about(spark, str(files / "l.11.1read"))
    assert [h["command"] for h in about["history"]] == ["bam21read", "bam21read", "merge1read", "addLCA", "extractReads 11"] and about["statistics"]["n_reads"] == n
    capsys.readouterr()
    run(files, "stat", "/l.11.1read", "--usage")
    out = capsys.readouterr().out
    assert out.count("|ok") == 5 and "|S     |" in out
    spark.read.parquet(str(files / "l.11.1read")).drop("place").write.parquet(str(files / "bare.1read"))  # a table without statistics gets them
    run(files, "stat", "/bare.1read")
    assert "|missing" in capsys.readouterr().out
    run(files, "stat", "/bare.1read", "--header")
    assert capsys.readouterr().out.count("|ok") == 5
    run(files, "view", "/l.11.1read", "--index", "0", "--index", "1-3")
    assert capsys.readouterr().out.count("\nI ") + 0 == 3
    run(files, "view", "/l.11.1read", "--head")
    assert "extractReads 11" in capsys.readouterr().out


def names_of(files, name):
    """Names in the order of a folder's files."""
    out = []
    for p in sorted((files / name).glob("[hp]*")):
        out += [x.split("\t")[0] for x in p.read_text().splitlines() if not x.startswith("@")]
    return out


def told(df):
    return sorted((r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.score, r.md, r.aux["XB"]) for r in df.collect())


def test_bamsort(spark, files):
    run(files, "bamsort", "/a.sam", "/b.sam", "-o", "/s.bam")
    run(files, "bamsort", "/s.bam", "/a.sam", "--keep-header")  # from both formats, under a name of its own
    heads = [x for p in (files / "s.sorted.sam").glob("header*") for x in p.read_text().splitlines()]
    assert heads[0] == "@HD\tVN:1.6\tSO:queryname" and sum(h.startswith("@SQ") for h in heads) == 94 and sum(h.startswith("@PG") for h in heads) >= 3
    parts = sorted(str(p) for p in (files / "s.bam").glob("part-*.bam"))
    names = [r.qname for p in parts for r in spark.read.format("bam").load(p).orderBy("ord").collect()]
    assert names == sorted(names) and len(names) == text.sam(spark, str(files / "a.sam")).count() + text.sam(spark, str(files / "b.sam")).count()
    run(files, "bamsort", *parts, "--merge", "-o", "/merged.sam")
    assert names_of(files, "merged.sam") == names
    with pytest.raises(ValueError, match="order"):
        (files / "bad.sam").write_text("@SQ\tSN:x\tLN:5\nb\t0\tx\t1\t0\t1M\t*\t0\t0\tA\tI\na\t0\tx\t1\t0\t1M\t*\t0\t0\tA\tI\n")
        run(files, "bamsort", "/bad.sam", "--merge", "-o", "/never")
    assert not (files / "never/_SUCCESS").exists()


def test_what_bamsort_writes_is_read_again(spark, files, capsys):
    both = told(text.sam(spark, str(files / "a.sam")).unionByName(text.sam(spark, str(files / "b.sam"))))
    for out in ("x.sam", "x.bam"):
        run(files, "bamsort", "/a.sam", "/b.sam", "-o", f"/{out}")
        assert told(cli.alignments(spark, str(files / out))) == both
        assert cli.headers(spark, str(files / out)).where("kind = '@SQ'").count() == 94
        run(files, "bamsort", "--merge", f"/{out}", "-o", f"/again.{out}")  # takes its own output, of many parts
        assert told(cli.alignments(spark, str(files / f"again.{out}"))) == both
        run(files, "seqstat", f"/{out}")
        assert f"|{len(both)}" in capsys.readouterr().out
    run(files, "makeAccTax", "/acc.tsv", "-o", "/again.1acctax")
    tables = []
    for source in ("x.sam", "x.bam"):
        run(files, "bam21read", "/again.1acctax", f"/{source}", "-o", f"/{source}.1read")
        tables.append(sorted(map(str, spark.read.parquet(str(files / f"{source}.1read")).collect())))
    assert tables[0] == tables[1] and len(tables[0]) == 240
    run(files, "bamsort", "--merge", "/x.sam", "/x.bam", "-o", "/both.bam")  # both formats; each name twice as often
    assert told(cli.alignments(spark, str(files / "both.bam"))) == sorted(both + both)


def test_history_of_a_table_rewritten_in_place(spark, files):
    spark.range(3).selectExpr("cast(id as string) as name", "'acgt' as seq", "'IIII' as qual", "1 as max_score", "'....' as mline", "cast(null as int) as dust", "cast(null as int) as lca", "array(named_struct('taxid', 11, 'best_score', 1, 'cnt', 1L)) as tax").write.parquet(str(files / "h.1read"))
    sinks.noted(spark, str(files / "h.1read"), "made")
    run(files, "addLCA", "/tax", "/h.1read", "-o", "-")
    about = sinks.about(spark, str(files / "h.1read"))
    assert [x["command"] for x in about["history"]] == ["made", "addLCA"] and about["statistics"]["n_reads"] == 3
    assert {r.lca for r in spark.read.parquet(str(files / "h.1read")).collect()} == {11}
    sinks.rewritten(spark.read.parquet(str(files / "h.1read")).where("name <> '1'"), str(files / "h.1read"))
    assert len(sinks.about(spark, str(files / "h.1read"))["history"]) == 2


def test_tags_as_columns(spark, files):
    run(files, "bam21bam", "/a.sam", "--acc-tax", "/acc.1acctax", "--aux", "XB:B", "--aux", "AS:c", "--aux", "XH:H") if (files / "acc.1acctax").exists() else run(files, "bam21bam", "/a.sam", "--aux", "XB:B", "--aux", "AS:c", "--aux", "XH:H")
    r = spark.read.parquet(str(files / "a.1bam")).first()
    assert r.tag_XB == [1.0, 2.0] and isinstance(r.tag_AS, int) and r.tag_XH == "1F"
    with pytest.raises(ValueError, match="TAG:FMT"):
        cli.tag_formats(["XX:q"])


def test_sequences(spark, files, capsys):
    (files / "s.fa").write_text(">a x\nAACCnnnnGT\n>\nggg\n")
    run(files, "seqconvert", "/s.fa")
    got = [r.value for r in spark.read.text(str(files / "s.fq")).collect()]
    assert "@a x" in got and "@2" in got and "!!!" in got
    run(files, "seqconvert", "/s.fa", "--fasta", "--collapse", "-o", "/h.fa")
    run(files, "seqconvert", "/h.fa", "--fasta", "--expand", "-o", "/e.fa")
    seqs = lambda name: {r.id: r.seq for r in text.fasta(spark, str(files / name)).collect()}
    assert seqs("h.fa") == {"a": "ACnGT", "2": "g"} and seqs("e.fa") == {"a": "AACCnnnnGT", "2": "ggg"}
    run(files, "seqconvert", "/s.fa", "--fasta", "--break-gaps", "3", "--upper", "-o", "/b.fa")
    assert sorted(seqs("b.fa").values()) == ["AACC", "GGG", "GT"]
    run(files, "seqconvert", "/b.fa", "--fasta", "--join", "-o", "/j.fa")
    assert seqs("j.fa") == {"a": "AACCnnnnGT", "2": "GGG"}
    run(files, "seqconvert", "/s.fa", "--packed", "-o", "/p.bin")
    run(files, "seqconvert", "/p.bin", "--fasta", "-o", "/pp.fa")
    assert seqs("pp.fa") == {"a": "aaccaaaagt", "2": "ggg"}
    run(files, "seqconvert", "/a.sam", "--quantise", "30", "--container", "-o", "/c.1txt")
    rows = one.reads(spark, str(files / "c.1txt"))
    assert rows.where(F.col("qual") != F.lit("?" * 50)).count() == 0 and rows.count() == text.sam(spark, str(files / "a.sam")).count()
    run(files, "view", "/c.1txt", "--index", "0", "-o", "/one.1txt")
    assert one.reads(spark, str(files / "one.1txt")).count() == 1
    capsys.readouterr()
    (files / "own.1txt").write_text("1 3 abc 1 1\n~ O S 1 3 DNA\n~ D X 2 3 INT 11 STRING_LIST\nS 3 acg\nX 7 2 2 ab 1 c\nS 2 gg\n")
    run(files, "view", "/own.1txt", "--head")
    assert capsys.readouterr().out == "1 3 abc 1 1\n~ O S 1 3 DNA\n~ D X 2 3 INT 11 STRING_LIST\n"
    run(files, "view", "/own.1txt", "--schema")
    assert capsys.readouterr().out == "P 3 abc\nO S 1 3 DNA\nD X 2 3 INT 11 STRING_LIST\n"
    run(files, "stat", "/own.1txt", "--header")
    assert "# S 2\n@ S 3\n+ S 5\n# X 1\n@ X 2\n+ X 2" in capsys.readouterr().out
    run(files, "seqstat", "/a.sam", "--bases", "--qualities", "--lengths", "--identifiers")
    out = capsys.readouterr().out
    assert "n50" in out and "shared_prefix" in out and json.dumps(0) in out
