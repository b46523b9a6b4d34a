"""The package's tables made from star-schema ones, in Spark and as SQL, so that operators have inputs of any size.

A region, a nation and a supplier are taxa below each other; a line item is an alignment of the read
that its order stands for to the reference that its supplier stands for; a document's letters a, c, g, t and n are a
sequence. Reads of the sequences are placed on suppliers by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.functions import flat

GROUPS = {"AFRICA": "animals", "AMERICA": "plants", "ASIA": "fungi", "EUROPE": "bacteria", "MIDDLE EAST": "archaea"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    parts = (
        spark.range(1).selectExpr("1 as taxid", "1 as parent", "'no rank' as rank", "'root' as name"),
        table(spark, sf, "region").selectExpr("10 + r_regionkey as taxid", "1 as parent", "'kingdom' as rank", "r_name as name"),
        table(spark, sf, "nation").selectExpr("100 + n_nationkey as taxid", "10 + n_regionkey as parent", "'family' as rank", "n_name as name"),
        table(spark, sf, "supplier").selectExpr("cast(1000 + s_suppkey as int) as taxid", "100 + s_nationkey as parent", "'species' as rank", "s_name as name"),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accession_taxa(spark: SparkSession, sf: str) -> DataFrame:
    su = table(spark, sf, "supplier").where("s_suppkey % 17 <> 3").selectExpr("s_suppkey as ord", "concat('SU', lpad(cast(s_suppkey as string), 6, '0')) as accession", "cast(1000 + s_suppkey as int) as taxid")
    pa = table(spark, sf, "part").where("p_partkey % 23 <> 5").selectExpr("p_partkey as ord", "concat('PA', lpad(cast(p_partkey as string), 6, '0')) as accession", "cast(2000 + floor(p_partkey / 7) as int) as taxid")
    return su.unionByName(pa)


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('R', lpad(cast(l_orderkey as string), 9, '0')) as qname",
        "case when l_returnflag = 'R' then 16 else 0 end + case when l_linenumber = 7 then 4 else 0 end as flag",
        "case when l_linenumber <> 7 then concat('SU', lpad(cast(l_suppkey as string), 6, '0'), '.1') end as rname",
        "case when l_linenumber < 6 then -cast(floor(l_quantity) as int) end as score",
        "concat(l_partkey, ':', l_suppkey) as cigar", "cast(l_suppkey % 3 as int) as file",
        "struct(l_linenumber as a, l_partkey as b, l_suppkey as c, cast(l_extendedprice as double) as d) as ord",
    )


def read_taxa(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments with the taxon of their reference."""
    from readlake.operators import reads

    refs = accession_taxa(spark, sf).select(F.concat("accession", F.lit(".1")).alias("accession"), "taxid")
    return reads.with_taxa(alignments(spark, sf), refs)


#: Letters of which the fixture makes match lines and qualities at once.
LETTERS = 1 << 20
OTHER = np.full(256, ord("."), np.uint8)
OTHER[np.frombuffer(b"acgtn", np.uint8)] = np.frombuffer(b"CGTAN", np.uint8)


#: The letters of a sequence by the byte of a text; 0: none.
KEPT = np.zeros(256, np.uint8)
KEPT[np.frombuffer(b"acgtnACGTN", np.uint8)] = np.frombuffer(b"acgtnacgtn", np.uint8)


@F.arrow_udf(T.StringType())
def _seq(text: pa.Array) -> pa.Array:
    """The letters a, c, g, t and n of a text, in small letters."""
    def told(t: pa.Array) -> pa.Array:
        x = flat.Flat(t)
        letters = KEPT[x.data]
        kept = letters > 0
        return flat.strings(letters[kept], np.r_[0, np.cumsum(kept)][x.offsets], flat.nulls(t))

    return flat.in_stretches(told, LETTERS, text)


@F.arrow_udf(T.StringType())
def _mline(seq: pa.Array, doc_id: pa.Array) -> pa.Array:
    """`-` at each 97th place and another letter at each 11th one seven on, counted from the document's number; else `.`."""
    def told(s: pa.Array, d: pa.Array) -> pa.Array:
        x, of = flat.Flat(s), d.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, counted = x.places() + 1, ~flat.nulls(d)[x.rows()]
        edit = np.where((at * 7 + of[x.rows()]) % 11 == 0, OTHER[x.data], ord("."))
        line = np.where(counted, np.where((at + of[x.rows()]) % 97 == 0, ord("-"), edit), ord(".")).astype(np.uint8)
        return flat.strings(line, x.offsets, flat.nulls(s))

    return flat.in_stretches(told, LETTERS, seq, doc_id)


@F.arrow_udf(T.StringType())
def _qual(seq: pa.Array) -> pa.Array:
    """A quality of 0 to 40 for each letter, by the letter and its place."""
    def told(s: pa.Array) -> pa.Array:
        x = flat.Flat(s)
        return flat.strings((33 + (x.data + x.places()) % 41).astype(np.uint8), x.offsets, flat.nulls(s))

    return flat.in_stretches(told, LETTERS, seq)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(name, doc_id, seq, mline, qual, max_score, lca) of every document with a letter of a sequence."""
    some = table(spark, sf, "documents").where(F.col("text").rlike("[acgtnACGTN]"))
    seqs = some.selectExpr("doc_id", "concat('D', lpad(cast(doc_id as string), 9, '0')) as name", "text").select("doc_id", "name", _seq("text").alias("seq"))
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n_su"))
    return seqs.crossJoin(F.broadcast(n)).select("name", "doc_id", "seq", _mline("seq", "doc_id").alias("mline"), _qual("seq").alias("qual"), (-(F.col("doc_id") % 50)).cast("int").alias("max_score"), F.when(F.col("doc_id") % 9 != 4, 1000 + F.col("doc_id") % F.col("n_su")).cast("int").alias("lca"))


#: CIGAR, MD, and the match line of a forward and of a reverse read of eleven bases.
LINES = (("11M", "11", "...........", "..........."), ("2S9M", "3A5", "--...A.....", ".....T...--"), ("4M1I6M", "0C9", "C...-......", "......-...G"), ("5M2D6M", "5^AC6", "...........", "..........."))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments (schemas.ALIGNMENTS) of whole records: bases and qualities follow from the read's name, CIGAR and MD from LINES."""
    def by_kind(i: int) -> str:
        return "case l_suppkey % 4 " + " ".join(f"when {k} then '{line[i]}'" for k, line in enumerate(LINES)) + " end"

    return table(spark, sf, "lineitem").selectExpr(
        "concat('R', lpad(cast(l_orderkey as string), 9, '0')) as qname", "case when l_returnflag = 'R' then 16 else 0 end as flag",
        "concat('SU', lpad(cast(l_suppkey as string), 6, '0'), '.1') as rname", "cast(1 + l_partkey as long) as pos", "cast(l_linenumber as int) as mapq", f"{by_kind(0)} as cigar",
        "cast(null as string) as rnext", "0L as pnext", "0 as tlen", "concat(translate(lpad(cast(l_orderkey as string), 9, '0'), '0123456789', 'ACGTACGTAC'), 'AC') as seq",
        "concat(translate(lpad(cast(l_orderkey as string), 9, '0'), '0123456789', 'ABCDEFGHIJ'), 'KL') as qual", "-cast(floor(l_quantity) as int) as score", f"{by_kind(1)} as md",
        f"map('AS', cast(-cast(floor(l_quantity) as int) as string), 'MD', {by_kind(1)}, 'XB', concat('S,', l_linenumber, ',', l_suppkey % 7)) as aux",
        "cast(l_suppkey % 3 as string) as file", "l_linenumber * 1000000000000L + l_partkey * 1000000L + l_suppkey as ord",
    )


SQL_RECORDS = f"""rec as (select 'R' || lpad(cast(l_orderkey as varchar), 9, '0') as qname, case when l_returnflag = 'R' then 16 else 0 end as flag,
    'SU' || lpad(cast(l_suppkey as varchar), 6, '0') || '.1' as rname, cast(1 + l_partkey as bigint) as pos, cast(l_linenumber as integer) as mapq, l_suppkey % 4 as kind, k.cigar, k.md, k.forth, k.back,
    translate(lpad(cast(l_orderkey as varchar), 9, '0'), '0123456789', 'ACGTACGTAC') || 'AC' as seq, translate(lpad(cast(l_orderkey as varchar), 9, '0'), '0123456789', 'ABCDEFGHIJ') || 'KL' as qual,
    -cast(floor(l_quantity) as integer) as score, l_suppkey, l_linenumber, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as ord, 1000 + l_suppkey as taxid
  from lineitem join (values {', '.join(f"({i}, " + ', '.join(f"'{x}'" for x in line) + ')' for i, line in enumerate(LINES))}) k(kind, cigar, md, forth, back) on k.kind = l_suppkey % 4)"""
SQL_NODES = """nodes as (
  select 1 as taxid, 1 as parent, 'no rank' as rank, 'root' as name
  union all select 10 + r_regionkey, 1, 'kingdom', r_name from region
  union all select 100 + n_nationkey, 10 + n_regionkey, 'family', n_name from nation
  union all select cast(1000 + s_suppkey as integer), 100 + s_nationkey, 'species', s_name from supplier)"""
SQL_LINEAGE = (
    SQL_NODES
    + """, up as (
  select taxid, taxid as ancestor, 0 as up from nodes
  union all select u.taxid, n.parent, u.up + 1 from up u join nodes n on n.taxid = u.ancestor where n.parent <> n.taxid),
lineage as (select taxid, ancestor, cast(max(up) over (partition by taxid) - up as integer) as depth from up)"""
)
SQL_ACCESSIONS = """acc as (
  select s_suppkey as ord, 'SU' || lpad(cast(s_suppkey as varchar), 6, '0') as accession, cast(1000 + s_suppkey as integer) as taxid from supplier where s_suppkey % 17 <> 3
  union all select p_partkey, 'PA' || lpad(cast(p_partkey as varchar), 6, '0'), cast(2000 + p_partkey // 7 as integer) from part where p_partkey % 23 <> 5)"""
SQL_ALIGNMENTS = (
    SQL_ACCESSIONS
    + """, ali as (
  select 'R' || lpad(cast(l_orderkey as varchar), 9, '0') as qname,
    case when l_returnflag = 'R' then 16 else 0 end + case when l_linenumber = 7 then 4 else 0 end as flag,
    case when l_linenumber <> 7 then 'SU' || lpad(cast(l_suppkey as varchar), 6, '0') || '.1' end as rname,
    case when l_linenumber < 6 then -cast(floor(l_quantity) as integer) end as score,
    l_partkey || ':' || l_suppkey as cigar, cast(l_suppkey % 3 as integer) as file,
    (l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord from lineitem),
tali as (select ali.*, coalesce(acc.taxid, 0) as taxid from ali left join acc on ali.rname = acc.accession || '.1'),
rt as (select qname, taxid, cast(coalesce(max(score), -16384) as integer) as best_score, count(*) as cnt from tali group by all)"""
)
SQL_SEQUENCES = """raw as (
  select doc_id, 'D' || lpad(cast(doc_id as varchar), 9, '0') as name, regexp_replace(lower(text), '[^acgtn]', '', 'g') as seq from documents),
seqs as (
  select name, doc_id, seq, cast(-(doc_id % 50) as integer) as max_score,
    cast(case when doc_id % 9 <> 4 then 1000 + doc_id % (select count(*) from supplier) end as integer) as lca from raw where seq <> ''),
letters as (
  select name, doc_id, len(seq) as len, lca, i, seq[i] as base,
    case when (i + doc_id) % 97 = 0 then '-' when (i * 7 + doc_id) % 11 = 0 then upper(translate(seq[i], 'acgtn', 'cgtan')) else '.' end as edit,
    (ascii(seq[i]) + i - 1) % 41 as q
  from (select *, unnest(range(1, len(seq) + 1)) as i from seqs))"""
