"""What the queries and the corpus pipeline derive from the operators' results alike."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm import byte_bpe, language


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encoded by the operator, decoded from its ids, and told in digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model of languages learns from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def language_model(docs: DataFrame) -> language.Model:
    seen = docs.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    return language.train(seen, order_by=F.col("doc_id"))


def overlaps(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
