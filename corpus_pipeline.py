"""From raw documents to token ids: STAGES, each a function of (spark, docs, sf_dir), and run().

Each stage works on all rows that its predecessor kept, which were written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import decontaminate, jaccard, language, pii
from readlake.llm.derived import bpe_digests, language_model
from readlake.llm.tables import checkpoint_dir, table

#: A document goes if less than this share of its letters lies in words that look like one of the learned languages, in whatever
#: mixture, and at least so many letters lie in others: a few odd words are no evidence.
LEAST_KNOWN, MOST_ODD = 0.5, 60


def _row(docs: DataFrame, *beside: Column) -> DataFrame:
    """Each row as one value beside its text, so that operators carry it along whole and each text once."""
    return docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text")).alias("row"), "text", *beside)


def _back(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text" if c == "text" else f"row.c{i}").alias(c) for i, c in enumerate(columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or mostly in none of the learned ones, go. Without any labelled text all with a letter stay."""
    try:
        model = language_model(docs)
    except ValueError:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(_row(docs), model, "row", with_text=True)
    odd = (F.col("known") < LEAST_KNOWN) & ((1 - F.col("known")) * F.col("letters") >= MOST_ODD)
    return _back(found.where((F.col("lang_pred") != "und") & ~odd), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest id, any id before none, of several texts under it the
    one with the smallest hash. Rows are told apart by id and text, so texts that only share an id are judged each; of rows that share
    both, that with the smallest hash of its other columns stays."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    rows = _row(docs, key.alias("key"))
    first = jaccard.join(docs.select(key.alias("key"), "text"), id_col="key").where("key = component_id").select(F.col("key").alias("first")).distinct()
    kept = rows.join(first, F.col("key") == F.col("first"), "left_semi")
    one = kept.groupBy("key").agg(F.min_by(F.struct("row", "text"), F.xxhash64(F.to_json("row"))).alias("kept"))
    return _back(one.select("kept.row", "kept.text"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.search(_row(docs), table(spark, sf_dir, "benchmark"), id_col="row", with_text=True)
    return _back(found.where(F.size("runs") == 0), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind; n_chars follows."""
    found = pii.find(docs, into="pii_spans")
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("pii_spans"))).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of what is left, as op1's query gives them."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", token_ids),
]

#: The language model is learned, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written under the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
