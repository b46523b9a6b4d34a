"""Sorted inputs merged by ranges of names, whatever the sizes of files, ranges and batches."""

import random

import pytest
from pyspark.errors import PythonException

from readlake.sources import bam, merging, text


def write(folder, rng, n_files, n, names):
    """Parts of SAM in order of name; the lines."""
    folder.mkdir()
    lines = [f"{name}\t0\tr1\t{1 + rng.randrange(90)}\t{i % 60}\t4M\t*\t0\t0\tACGT\tIIII\tXX:i:{i}" for i, name in enumerate(sorted(rng.choices(names, k=n)))]
    cuts = sorted(rng.choices(range(n + 1), k=n_files - 1))
    for k, (a, z) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
        (folder / f"part-{k:05d}.txt").write_text("".join(x + "\n" for x in lines[a:z]))
    (folder / "header.txt").write_text("@HD\tVN:1.6\n@SQ\tSN:r1\tLN:100\n")
    return lines


@pytest.mark.parametrize("size", [1 << 30, 3000, 400])
def test_merged_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(merging, "READ", 700)
    rng = random.Random(size)
    names = [f"n{rng.randrange(10**6)}" for _ in range(60)] + ["popular", "z", "é", "\U0001d11e"]
    weights = names + ["popular"] * 30  # a third of all lines share one name
    inputs = [write(tmp_path / f"in{i}", rng, k, 200, weights) for i, k in enumerate((1, 4, 7))]
    got = merging.merged(spark, [str(tmp_path / f"in{i}") for i in range(3)], size)
    assert got.rdd.getNumPartitions() > 3 or size > 10**6
    want = sorted((x.split("\t")[0].encode(), i, k, x) for i, some in enumerate(inputs) for k, x in enumerate(some))
    assert [r.value for r in got.collect()] == [x[3] for x in want]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_merged_bam_and_sam(spark, tmp_path):
    rng = random.Random(4)
    lines = write(tmp_path / "a", rng, 3, 300, [f"q{i:04d}" for i in range(200)])
    rows = text.sam(spark, str(tmp_path / "a"))
    bam.write(rows.repartitionByRange(4, "qname").sortWithinPartitions("qname", "mapq"), str(tmp_path / "b.bam"), spark.read.text(str(tmp_path / "a/header.txt")))
    got = merging.merged(spark, [str(tmp_path / "b.bam"), str(tmp_path / "a")], 2000).collect()
    assert [r.qname for r in got] == sorted(2 * [x.split("\t")[0] for x in lines])
    assert sorted(r.value.rsplit("\t", 1)[0] for r in got) == sorted(x.rsplit("\t", 1)[0] for x in 2 * lines)


def test_disordered_inputs_are_refused(spark, tmp_path):
    head, line = "@SQ\tSN:r1\tLN:100\n", "\t0\tr1\t1\t9\t1M\t*\t0\t0\tA\tI\n"
    (tmp_path / "x.sam").write_text(head + "".join(f"q{i:05d}{line}" for i in [*range(500), 3, *range(501, 900)]))
    with pytest.raises((ValueError, PythonException), match="order of name"):
        merging.merged(spark, [str(tmp_path / "x.sam")], 4000).count()
    (tmp_path / "d").mkdir()
    for k, names in enumerate((["b", "c"], ["a", "d"])):  # each part in order, the folder not
        (tmp_path / f"d/part-{k:05d}").write_text("".join(x + line for x in names))
    with pytest.raises(ValueError, match="order of name"):
        merging.merged(spark, [str(tmp_path / "d")], 10).count()
    (tmp_path / "empty.sam").write_text(head)
    assert merging.merged(spark, [str(tmp_path / "empty.sam")]).count() == 0
