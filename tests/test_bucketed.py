"""Tables of reads with buckets and places: merged and sliced without a shuffle, whatever they hold."""

import random

from pyspark.sql import functions as F

from readlake.operators import reads
from readlake.schemas import READS
from readlake.sources import bucketed, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_reads(rng, n):
    out = []
    for i in rng.sample(range(40), n):
        tax = [(t, -rng.randrange(9), rng.randrange(1, 5)) for t in rng.sample(range(1, 9), rng.randrange(4))]
        out.append((f"r{i}", "acgt"[: rng.randrange(1, 5)], rng.choice(["II", None]), rng.choice([None, -1, -5]), f"line{rng.randrange(99)}", None, None, tax or rng.choice([[], None])))
    return out


def brute(tables):
    want = {}
    for source, rows in enumerate(tables):
        for name, seq, qual, score, mline, _, _, tax in rows:
            w = want.setdefault(name, {"seq": seq, "qual": qual, "best": None, "tax": {}})
            if score is not None and (w["best"] is None or (score, -source) > w["best"][:2]):
                w["best"] = (score, -source, mline)
            for t, b, c in tax or []:
                old = w["tax"].get(t, (b, 0))
                w["tax"][t] = (max(b, old[0]), old[1] + c)
    return {(k, w["seq"], w["qual"], w["best"] and w["best"][0], w["best"] and w["best"][2], tuple((t, *w["tax"][t]) for t in sorted(w["tax"]))) for k, w in want.items()}


def told(df):
    return [(r.name, r.seq, r.qual, r.max_score, r.mline, tuple(map(tuple, r.tax))) for r in df.collect()]


def test_merged_where_they_lie(spark, tmp_path):
    rng = random.Random(3)
    tables = [some_reads(rng, n) for n in (30, 25, 0, 38)]
    frames = [spark.createDataFrame(t, READS) for t in tables]
    paths = [str(tmp_path / f"t{i}") for i in range(4)]
    for df, p in zip(frames, paths, strict=True):
        sinks.written(df, p, "made", buckets=5)
    merged = reads.merged_sources(bucketed.together(spark, paths))
    want = brute(tables)
    assert "Exchange" not in plan(merged)
    for df in (merged, reads.merged(*frames)):
        got = told(df)
        assert len(got) == len(set(got)) and set(got) == want
    sinks.written(merged, str(tmp_path / "m"), "merge", *paths, buckets=5, dealt=True)
    assert set(told(bucketed.read(spark, str(tmp_path / "m")))) == want
    again = bucketed.read(spark, str(tmp_path / "m")).groupBy("name").count()
    assert "Exchange" not in plan(again) and again.count() == len(want)
    assert len(list((tmp_path / "m").glob("part-*"))) <= 5
    sinks.written(frames[0], str(tmp_path / "other"), "made", buckets=4)
    sinks.written(frames[0], str(tmp_path / "plain"), "made")
    assert bucketed.together(spark, [paths[0], str(tmp_path / "other")]) is None and bucketed.together(spark, [paths[0], str(tmp_path / "plain")]) is None
    assert bucketed.read(spark, str(tmp_path / "plain")).columns == frames[0].columns == bucketed.read(spark, paths[0]).columns


def test_slices_open_what_holds_them(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("format_string('n%04d', id) as name", "'a' as seq", "array() as tax").repartitionByRange(8, "name").sortWithinPartitions("name")
    sinks.written(rows, path, "made")
    for ranges in ([(0, None)], [(5, 9), (700, None)], [(100, 900)], [(0, 1000)], [(999, 2000), (3, 3)], [(2000, None)]):
        got = {r.row_id: r.name for r in bucketed.slices(spark, path, ranges).collect()}
        wanted = sorted({i for x, y in ranges for i in range(x, x + 1 if y is None else min(y, 1000)) if i < 1000})
        assert got == {i: f"n{i:04d}" for i in wanted}
    one = bucketed.slices(spark, path, [(130, 133)])
    text = plan(one)
    assert len(one.inputFiles()) == 1 and "GreaterThanOrEqual(place" in text and "Sort" not in text and "ShuffleExchange" not in text
    assert one.columns == ["name", "seq", "tax", "row_id"] and bucketed.slices(spark, path, [(5000, None)]).columns == one.columns
    sinks.written(rows.limit(0), str(tmp_path / "none"), "made")
    assert bucketed.slices(spark, str(tmp_path / "none"), [(0, None)]).count() == 0
    sinks.written(rows.withColumn("extra", F.lit(1)), str(tmp_path / "b"), "made", buckets=3)
    assert sorted(r.row_id for r in bucketed.slices(spark, str(tmp_path / "b"), [(0, 1000)]).collect()) == list(range(1000))
