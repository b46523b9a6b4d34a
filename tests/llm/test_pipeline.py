"""The pipeline's stages on small tables: each does what its operator says to rows that its predecessor kept."""

import collections
import random
import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from readlake.llm import queries as Q
from readlake.llm.pii import find


def kept_of_groups(rows):
    """Of rows (id, text) those that stay: one of each group of linked texts, any with the smallest id before others."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    return {rows[i] for i in first.values()}


def test_near_duplicates_loses_no_text(spark, sf):
    words = [f"w{i}" for i in range(40)]
    long = " ".join(words)
    rows = [(7, "one text of this id here"), (7, "and another one under it"), (3, long), (4, long + " more"), (4, long), (None, "without an id there is this"), (None, "without an id there is this"), (None, long), (8, None), (9, ""), (10, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit(2).alias("id"), F.lit(3).alias("row"), F.lit("x").alias("first"), F.lit(0).alias("n_chars"))
    after = P.near_duplicates(spark, docs, sf)
    assert after.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in after.collect())
    assert set(got.values()) == {1} and set(got) == kept_of_groups(rows) and {k for k, _ in got} == {None, 3, 7, 8, 9, 10}


def test_near_duplicates_takes_the_same_row_of_repeated_ones(spark, sf):
    rows = [(1, "a text that stands here often", f"s{i}", {"n": i}) for i in range(12)] + [(1, "a text that stands here often", None, None), (2, "", "x", None), (2, "", "y", None)]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, more map<string, int>").repartition(3, "source")
        found.append(sorted((r.doc_id, r.text, r.source, r.more) for r in P.near_duplicates(spark, docs, sf).collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == [1, 2] and set((a, b, c) for a, b, c, _ in found[0]) <= {(a, b, c) for a, b, c, _ in rows}
    assert P.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (None, "the words of that text", None, None, 22), (9004, "these are long words " * 20_000, "en", "s", 420_000)], docs.schema))
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(out)
        after = spark.read.parquet(out)
        if i < len(P.STAGES) - 1:
            assert after.columns == columns
        if name == "language_id":
            assert after.where("doc_id in (9001, 9002, 9003)").count() == 0 and after.count() >= 0.9 * docs.count() - 3
        if name == "near_duplicates":
            kept = collections.Counter((r.doc_id, r.text) for r in after.collect())
            assert set(kept.values()) == {1} and set(kept) == kept_of_groups([(r.doc_id, r.text) for r in docs.collect()])
        if name == "decontamination":
            from readlake.llm.decontaminate import search

            bad = {r.doc_id for r in Q.overlaps(search(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
            assert {r.doc_id for r in docs.collect()} - bad == {r.doc_id for r in after.collect()}
        if name == "personal_data":
            assert after.count() == docs.count() and find(after).where("size(pii_spans) > 0").count() == 0
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = after
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_language_id_drops_what_no_learned_language_is_like(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    strange = [(9101, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(50))), (9102, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"), (9103, "zzqxk")]
    after = P.language_id(spark, docs.unionByName(spark.createDataFrame([(k, t, None, None, 1) for k, t in strange], docs.schema)), sf)
    ids = {r.doc_id for r in after.collect()}
    assert not ids & {9101, 9102} and 9103 in ids and ids - {9103} == {r.doc_id for r in docs.collect()}  # a word or two is no evidence


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
