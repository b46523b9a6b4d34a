"""Schemas of the tables, and a check of what an operator needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

ACCESSION_TAXA = "ord long, accession string, version string, taxid int"
INTERVALS = "prefix string, start long, count long, taxid int"
NODES = "taxid int, parent int, rank string, name string"
ALIGNMENTS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, score int, md string, aux map<string,string>, file string, ord long"
TAX = "array<struct<taxid:int,best_score:int,cnt:bigint>>"
READS = f"name string, seq string, qual string, max_score int, mline string, dust int, lca int, tax {TAX}"
SEQUENCES = "id string, description string, seq string, qual string"
HEADERS = "file string, ord long, kind string, tags map<string,string>"


def need(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else a ValueError that names those it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are needed; there are {df.columns}")
    return df
