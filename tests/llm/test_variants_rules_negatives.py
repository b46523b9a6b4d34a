"""Spelling variants, the rule ensemble and hard negatives against brute force and held-out labels, odd rows included."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from readlake.llm import negatives, rule_ensemble, variants
from readlake.llm import queries as Q


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, least, factor):
    n = {w: c for w, c in collections.Counter(words).items() if c >= least}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in by.items():
        top = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n}


def test_variants_of_words_over_few_letters(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abé𝄞", k=rng.randrange(0, 6))) for _ in range(3000)]
    words += ["aaaaaa"] * 700 + ["aaaaab"] * 120 + ["aaaabb"] * 20 + ["aaabbb"] * 4  # forms in a row; a third of all rows are one word
    words += ["x" * 3000 + "y"] * 5 + ["x" * 3000] * 60 + ["x" * 2999 + "yy"] * 5  # words of any length
    df = spark.createDataFrame([(w,) for w in words] + [(None,)] * 9, "word string").select("word", F.lit(1).alias("id"), F.lit("k").alias("key"), F.lit(0).alias("n"))
    for least, factor in ((1, 2), (4, 5)):
        got = variants.group(df, least=least, factor=factor).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_groups(words, least, factor)
    assert variants.group(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="above 1"):
        variants.group(df, factor=1)


def test_near_words_share_one_key():
    words = ["".join(w) for k in range(5) for w in itertools.product("abc", repeat=k)]
    row, key = variants.keys_of(words)
    keys = [set() for _ in words]
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        assert k not in keys[r]  # of a word's deletions each comes once
        keys[r].add(k)
    for (i, a), (j, b) in itertools.combinations(enumerate(words), 2):
        if near(a, b):
            assert len(keys[i] & keys[j]) == 1
        want = {a, *(a[:p] + a[p + 1 :] for p in range(len(a)))} & {b, *(b[:p] + b[p + 1 :] for p in range(len(b)))}
        assert len(keys[i] & keys[j]) == len(want)


def test_runs_of_letters(spark):
    rows = [(1, "ABCDÉF-abc_ ×÷"), (None, "word\x00words"), (3, None), (4, ""), (5, "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("run", F.lit("y"))
    got = sorted((r.id, r.run) for r in variants.runs(df, Q.LETTERS).collect())
    assert got == sorted([("1", "ABCDÉF"), ("1", "abc"), ("1", "×÷"), ("", "word"), ("", "words"), ("5", "a" * 200_000)])
    assert sorted(r.run for r in variants.runs(df, Q.LETTERS, 5).collect()) == sorted(["ABCDÉF", "words", "a" * 200_000])


def test_rule_ensemble_on_labels_that_are_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op12_rule_ensemble(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= Q.GOOD_SCORE) for r in got.values())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for wanted in (0, 1):
        some = [got[x.doc_id].predicted == wanted for x in labels if x.quality == wanted and got[x.doc_id].held_out]
        assert len(some) >= 10 and sum(some) >= 0.9 * len(some)


def labelled_rows(spark, rows):
    """rule_ensemble.labelled() of rows (id, text, label)."""
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return rule_ensemble.labelled(rule_ensemble.statistics(df), df)


def test_rules_are_what_they_say(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        words = [rng.choice(["some", "words", "of", "it"]) + (rng.choice("###$$$") if bad and rng.random() < 0.8 else "") for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), 0 if bad or i % 7 == 0 else 1))
    labelled = labelled_rows(spark, rows)
    model = rule_ensemble.learn(labelled)
    assert 0 < len(model.rules) < 200
    stats = rule_ensemble.statistics(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = {r.doc_id: r.s for r in stats.select("doc_id", model.score().alias("s")).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert right >= 0.97 * len(rows)
    # the expression against its rules one by one
    import math

    features = {r.doc_id: r for r in stats.select("doc_id", *(F.expr(e).alias(f) for f, e in rule_ensemble.FEATURES.items())).collect()}
    for i in range(0, 400, 37):
        total = model.intercept + sum(r.weight for r in model.rules if all(features[i][f] <= t if op == "<=" else features[i][f] > t for f, op, t in r.conditions))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))
    for r in model.rules:
        assert r.weight and len(r.conditions) <= 3 and len({c[:2] for c in r.conditions}) == len(r.conditions)


def test_statistics_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Ab ab. 12\n\nab\nÉé #x"), (4, "again"), (None, "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("key"), F.lit(2).alias("n_words"))
    got = collections.defaultdict(list)
    for r in rule_ensemble.statistics(df).collect():
        got[r.doc_id].append(r.asDict())
    assert all(v == 0 for k in (1, 2, 3) for c, v in got[k][0].items() if c != "doc_id") and len(got[4]) == 2
    r = max(got[4], key=lambda r: r["n_words"])
    assert (r["n_words"], r["n_distinct"], r["n_lines"], r["n_upper"], r["n_letters"], r["n_digits"], r["n_marks"], r["n_symbols"]) == (6, 5, 3, 1, 9, 2, 1, 1)
    assert got[None][0]["word_chars"] == 100_000


def test_ensembles_of_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (None, "x y"), (5, "z")], "doc_id long, text string").withColumn("y", F.lit(1)).withColumn("score", F.lit("s"))
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 3.5 / 4), ([(1, 0)], 0.5 / 3), ([(1, 1), (1, 0), (7, 1), (2, None), (None, 0)], 0.5)):
        got = rule_ensemble.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert got.columns == ["doc_id", "score"] and [round(r.score, 9) for r in got.collect()] == [round(want, 9)] * 5
    assert rule_ensemble.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def brute_negatives(rows, every, k, m, scale=256.0):
    import math

    used = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, label, [math.floor(scale * x) for x in v]))

    def score(a, b):
        return max(min(sum(x * y for x, y in zip(a[2], b[2], strict=False)), negatives.MOST), negatives.LEAST)

    out = collections.Counter()
    for a in used:
        if a[0] % every == 0:
            scored = [(score(a, b), b) for b in used]
            first = sorted(((-s, b[0]) for s, b in scored if b[1] == a[1] and b[0] != a[0]))[:k]
            for ps, p in first:
                fits = sorted((-s, b[0]) for s, b in scored if b[1] != a[1] and 80 * -ps <= 100 * s <= 100 * -ps)[:m]
                out.update((a[0], p, rank, b, -ps, -s) for rank, (s, b) in enumerate(fits, 1))
    return out


def mined(df, **options):
    return collections.Counter(tuple(r) for r in negatives.mine(df, **options).collect())


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(11)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.randrange(4)) for i in range(500)]
    rows += [(1000 + i, [0.25, -0.125, 0.5, 0.0, 0.0, 0.25, 0.0, 1.0], i % 3) for i in range(300)]  # a third of all rows are one vector
    rows += [(2000 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)], rng.choice([0, 1])) for i in range(60)]  # ties
    rows += [(3000, None, 1), (3010, [], 2), (3020, [0.5, 1.0], 1), (3030, [None] * 8, 1), (3040, [nan] * 8, 1), (3050, [0.1] * 7 + [inf], 1), (3060, [0.5] * 8, None), (None, [0.5] * 8, 1), (-40, [0.3] * 8, 7), (3070, [1.0, 1.0], 7)]
    rows += [rows[20], rows[21], rows[540]]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit("x").alias("id"), F.lit(1).alias("n"), F.lit(2).alias("v")).repartition(3)
    rows = [tuple(r)[:3] for r in df.collect()]
    want = brute_negatives(rows, 20, 5, 5)
    assert mined(df, every=20) == want and len(want) > 200
    monkeypatch.setattr(negatives, "SENT", 7)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "CELLS", 4)
    assert mined(df, every=20, positives=3, negatives=2, bound=40) == brute_negatives(rows, 20, 3, 2)
    assert mined(df.where("vec_id < 0"), every=20) == {} and mined(df.limit(0)) == {} and mined(df.where("vec_id = 3")) == {}


def test_bounds_hold_and_leave_few_rows(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 64)))
    cells = negatives.Cells([np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1], method="nearest")) for j in range(64)], None, None)
    cells.middle, cells.half = np.zeros((64, 256)), np.zeros((64, 256))
    for j, b in enumerate(cells.borders):
        a, z = np.r_[x[:, j].min(), b], np.r_[b - 1, x[:, j].max()]
        cells.middle[j, : len(a)], cells.half[j, : len(a)] = (a + z) / 2, (z - a) / 2
    middle, half = cells.looked_up(cells.approximated(x))
    assert (np.abs(x - middle) <= half).all()
    label = rng.integers(0, 3, 3000)
    some = negatives.Anchors(np.arange(40), label[:40], x[:40], 5)
    scored = []
    monkeypatch.setattr(negatives, "exact", lambda x, q, i, j, f=negatives.exact: (scored.append(len(i)), f(x, q, i, j))[1])
    lists = negatives.Lists(40, 5)
    negatives._searched(some, cells, x, np.arange(3000), label, lists)
    for k in range(40):
        s = np.where((label == label[k]) & (np.arange(3000) != k), x @ x[k], -np.inf)
        assert lists.score[k].tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert sum(scored) <= 0.1 * 40 * 1000  # of the rows of the anchors' labels


def test_scores_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0], 0), (1, [2e38, 5.0], 0), (2, [1e30, 2.0], 0), (3, [1e38, 0.0], 1), (4, [-3e38, 0.0], 1), (5, [0.0, 9.0], 1), (10, [1e9, 7.0], 2), (11, [1e9, 6.0], 2), (12, [9.5e8, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(df, every=10) == brute_negatives([tuple(r) for r in df.collect()], 10, 5, 5)
