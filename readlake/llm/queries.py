"""The queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import chat, decontaminate, jaccard, language, negatives, passages, pii, quality_rules, rule_ensemble, token_counts, url_filter, variants
from readlake.llm.derived import bpe_digests, held_out, language_model, overlaps
from readlake.llm.tables import table

TOKEN_LIMIT = 4096


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: A conversation whose texts hold the template's own control strings.
CONFLICT = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(added)), in_order=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    stats = quality_rules.statistics(docs)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return stats.select("doc_id", *quality_rules.STATS, failed.alias("base_failed"), (~failed & rules.kept()).alias("kept"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = pii.told(pii.of_kind(spans, *pii.BASE))
    return found.select("doc_id", *pii.counts(spans), F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.told(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_pii alone, which SQL can express."""
    return op8_pii(spark, sf_dir).drop("spans", "n_spans")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", size.alias("n_repeated"), F.size("passages").cast("long").alias("n_passages"), spans.alias("passages"))


#: (verdict, host/path)
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Letters of a word, the least code points of one, and of how many occurrences, told by a hash, one loses a letter.
LETTERS, LEAST_LETTERS, TYPED = "A-Za-z\u00C0-\u00FF", 6, 199


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.runs(table(spark, sf_dir, "documents"), LETTERS, LEAST_LETTERS)
    run = F.col("run")
    low = found.select("id", F.when(run.rlike("[A-Z]"), F.translate(run, url_filter.UPPER, url_filter.LOWER)).otherwise(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    typed = low.select(F.when(h % TYPED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))
    return variants.group(typed.where(F.length("word") >= LEAST_LETTERS))


#: At this score or above a text is predicted to be good.
GOOD_SCORE = 0.3


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held(doc_id: Column) -> Column:
        return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0

    seen = table(spark, sf_dir, "labels").where(~held(F.col("doc_id")))
    found = rule_ensemble.score(table(spark, sf_dir, "documents"), seen)
    return found.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # lies at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_language": op2_language,
        "op3_jaccard": op3_jaccard,
        "op4_decontamination": op4_decontamination,
        "op5_chat": op5_chat,
        "op6_quality_rules": op6_quality_rules,
        "op7_token_counts": op7_token_counts,
        "op8_pii": op8_pii,
        "pii_base": pii_base,
        "op9_passages": op9_passages,
        "op10_url_filter": op10_url_filter,
        "op11_variants": op11_variants,
        "op12_rule_ensemble": op12_rule_ensemble,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""with recursive w as (
  select doc_id, list_filter(string_split_regex({_LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from places),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
reach as (select a, a as b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce((select min(b) from reach where a = w.doc_id), w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""with b as (select item_id, {_WORDS} as w from benchmark),
p as (select distinct cast(item_id as varchar) as item, m, array_to_string(w[i : i + m - 1], ' ') as p
  from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
places as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from p)),
found as (select doc_id, item, places.m, i from places join p on p.m = places.m and p.p = array_to_string(w[i : i + places.m - 1], ' ')),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""

OP5_SQL = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONFLICT}'), (-1, 1, 'assistant', '{CONFLICT}')),
r as (select *, 24 + length(role) + length(text) + case when contains(text, '<|im_end|>') or regexp_matches(text, '<\\+\|') then len(regexp_extract_all(text, '<\\*\|')) else 0 end as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from r group by conv_id"""


#: Base kinds: expression, and which matches x count; d: their digits.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and([try_cast(p as hugeint) <= 255 for p in string_split(x, '.')])"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "len({d}) between 16 and 19 and list_sum([case when (len({d}) - i) % 2 = 0 then ({d}[i])::int when ({d}[i])::int > 4 then 2 * ({d}[i])::int - 9 else 2 * ({d}[i])::int end for i in range(1, len({d}) + 1)]) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len({d}) between 8 and 15"),
}


def _pii_sql() -> str:
    """Matches and the pieces between them by expressions; a match starts where the pieces and matches before it end."""
    t = "coalesce(text, '')"
    hits = ", ".join(f"regexp_extract_all({t}, '{p}') as h_{k}, string_split_regex({t}, '{p}') as p_{k}" for k, (p, _) in _PII.items())
    rows = " union all ".join(
        f"select doc_id, row, {n} as o, '{k}' as kind, unnest(h_{k}) as x, unnest(list_transform(range(1, len(h_{k}) + 1), lambda i: list_sum(list_transform(p_{k}[1:i], lambda v: len(v))) + coalesce(list_sum(list_transform(h_{k}[1:i - 1], lambda v: len(v))), 0))) as a from t"
        for n, k in enumerate(_PII)
    )
    right = " ".join(f"when '{k}' then {test.format(d=_DIGITS)}" for k, (_, test) in _PII.items())
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in _PII)
    return rf"""with t as (select doc_id, row_number() over () as row, {hits} from documents), found as ({rows}),
good as (select *, kind || ':' || a::bigint || ':' || (a + len(x))::bigint as s from found where case kind {right} end)
select t.doc_id, {counts}, sha256(coalesce(string_agg(s, ',' order by o, a), '')) as base_sha256 from t left join good using (row) group by t.doc_id, row"""


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"


def _op10_sql() -> str:
    """Rules by string functions, links by expressions, and as many rounds as leave less than the tolerance on its way."""
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{{{i}}}'" for i, (h, _, p) in enumerate(r.partition("/") for _, r in ordered_rules()))
    rule, verdict = (fits.format(*(x[k] for x in ordered_rules())) for k in (1, 0))
    link, d = url_filter.LINK.replace("'", "''"), url_filter.DAMPING
    rounds = url_filter.ROUNDS * math.ceil(math.log(url_filter.TOLERANCE) / math.log(d) / url_filter.ROUNDS)
    steps = "".join(f"""
r{i + 1} as materialized (select host, sum(t) as t, sum(d) as d, sum(tw) as tw, sum(dw) as dw from (
  select next as host, 0.0 as t, 0.0 as d, a.t * tw * {d} as tw, a.d * dw * {d} as dw from arcs a join r{i} r on r.host = a.host
  union all select host, t + tw * {1 - d}, d + dw * {1 - d}, 0.0, 0.0 from r{i}) group by host),""" for i in range(rounds))
    return rf"""with h as (select page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
p as (select *, case {rule} end as rule, case {verdict} end as verdict from h),
found as (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{url_filter.UPPER}', '{url_filter.LOWER}') as dst from p),
above as (select host, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) as above from (select distinct host from p) where regexp_matches(host, '^[^.]+\.(.+\..+)$')),
links as materialized (select src, dst, count(*) as n from (select * from found union all select host, above from above union all select above, host from above)
  where src <> dst and src <> '' and dst <> '' group by src, dst),
shares as (select src, dst, n / sum(n) over (partition by src) as t, n / sum(n) over (partition by dst) as d from links),
arcs as materialized (select src as host, dst as next, t, 0.0::double as d from shares union all select dst, src, 0.0, d from shares),
hosts as materialized (select host, sum(t) as t, sum(d) as d from (select host, (verdict = 'allow')::int as t, (verdict = 'block')::int as d from p where host <> ''
  union all select src, 0, 0 from links union all select dst, 0, 0 from links) group by host),
sums as (select count(*) as n, greatest(coalesce(sum(t), 0), 0.5) as t, greatest(coalesce(sum(d), 0), 0.5) as d from hosts),
r0 as materialized (select host, 0.0::double as t, 0.0::double as d, coalesce(hosts.t, 0) / s.t as tw, coalesce(hosts.d, 0) / s.d as dw from hosts, sums s),{steps}
judged as (select host, n * d > n * t + {url_filter.TOLERANCE} and n * d >= 1 as bad from r{rounds}, (select n from sums))
select page_id, host, path, rule, coalesce(verdict, case when bad then 'block' else 'allow' end) as verdict from p left join judged using (host)"""


#: CRC-32 of a run behind its document's id, as the checksum is defined: a table of 256 entries, then byte after byte. All code points
#: are below 256, so UTF-8 has one byte or two of each. Two words are near if deleting one place of both leaves the same, or of one the other.
OP11_SQL = rf"""with recursive entries as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from (select unnest(range(256)) as i)),
runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{url_filter.UPPER}', '{url_filter.LOWER}') as run from documents),
heads as (select id || ':' as head, run, count(*) as c from runs where len(run) >= {LEAST_LETTERS} group by all),
bytes as (select *, flatten(list_transform(string_split(head || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)) as b from heads),
hashed as (select run, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295::bigint) as h from bytes, entries),
typed as (select case when h % {TYPED} = 0 then run[: h % len(run)] || run[h % len(run) + 2 :] else run end as word, c from hashed),
known as (select word, sum(c)::bigint as n from typed where len(word) >= {LEAST_LETTERS} group by word having sum(c) >= 5),
cuts as (select word, n, p, word[: p] || word[p + 2 :] as rest from (select *, unnest(range(len(word))) as p from known)),
near as (select a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join known b on a.rest = b.word union select b.word, a.word, a.n from cuts a join known b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as top from near group by word),
formed as (select known.word, known.n, coalesce(n_near, 0) as n_near, case when top >= 5 * known.n then form end as form, case when top >= 5 * known.n then top end as form_n from known left join best using (word)),
way as (select word, word as root from formed union all select way.word, formed.form from way join formed on formed.word = way.root where formed.form is not null)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from formed f join (select way.word, way.root from way join formed on formed.word = way.root where formed.form is null) w on w.word = f.word"""

OP13_SQL = """with e as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.row, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and (a.label <> b.label or a.vec_id <> b.vec_id)),
p as (select row, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by row order by score desc, id) as k from s where same qualify k <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.row, k order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.row = p.row and not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5"""


def ordered_rules() -> list[tuple[str, str]]:
    return sorted(URL_RULES, key=lambda x: -len(x[1]))


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others rest on tokenizers, learned models or added spans and have brute-force tests."""
    return {"op3_jaccard": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_chat": OP5_SQL, "pii_base": _pii_sql(), "op10_url_filter": _op10_sql(), "op11_variants": OP11_SQL, "op13_hard_negatives": OP13_SQL}
