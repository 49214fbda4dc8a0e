"""Registered queries of the operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, exact, language, lines, lm, mixing, near, negatives, pii, quality, repeats, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark, d):
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_personal_data(spark, d):
    return pii.detect(table(spark, d, "documents"))


@query
def op3_score_texts(spark, d):
    return lm.score_texts(table(spark, d, "documents"))


@query
def op4_fuzzy_lines(spark, d):
    return lines.deduplicated(table(spark, d, "documents"))


@query
def op5_near_duplicates(spark, d):
    return near.find_groups(table(spark, d, "documents"))


@query
def op6_language(spark, d):
    return language.identify(table(spark, d, "documents"))


@query
def op7_exact_dedup(spark, d):
    return exact.dedup_exact(table(spark, d, "documents"))


@query
def op8_repeated_passages(spark, d):
    return repeats.find_repeats(table(spark, d, "documents"))


@query
def op9_decontaminate(spark, d):
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op10_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source"))


@query
def op11_whiten(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


@query
def op12_warc(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


@query
def op13_hard_negatives(spark, d):
    rows = table(spark, d, "embeddings").withColumn(
        "label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op7_exact_dedup"] = f"""
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(body) as text_sha256
from (select doc_id, {_LOWER} as body from documents) d window w as (partition by body)"""

_FIRST = "min(page_id) over (partition by payload)"
ORACLES["op12_warc"] = f"""
select page_id, payload_bytes, sha256(payload) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  case when again then first_id end as refers_to
from (select page_id, payload, payload_bytes, {_FIRST} as first_id, payload_bytes >= 100 and page_id is distinct from {_FIRST} as again
  from (select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages) p) q"""

ORACLES["op13_hard_negatives"] = """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
anchors as (select *, row_number() over () as no from v where vec_id % 100 = 0),
scored as (select a.no, a.vec_id as anchor_id, b.vec_id, b.label = a.label as same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::bigint as score
  from anchors a join v b on b.vec_id <> a.vec_id),
positives as (select * from scored where same qualify row_number() over (partition by no order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
  row_number() over (partition by p.no, p.vec_id, p.score order by n.score desc, n.vec_id)::integer as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.no = p.no and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5"""

_WORDS = fr"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op9_decontaminate"] = f"""
with docs as (select doc_id, {_WORDS} as words from documents),
items as (select cast(item_id as varchar) as item, w as words, least(len(w), 10) as n
  from (select item_id, {_WORDS} as w from benchmark) i where len(w) > 0),
windows as (select distinct item, n, array_to_string(words[p:p + n - 1], ' ') as win
  from (select item, words, n, unnest(range(1, len(words) - n + 2)) as p from items) s),
sizes as (select distinct n from windows),
spots as (select doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') as win
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as p from docs cross join sizes where len(words) >= n) s),
hits as (select doc_id, p, n, item from spots join windows using (n, win)),
hit_words as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(p, p + n)) as w from hits) h group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item from hits) h group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (doc_id) left join hit_items using (doc_id)"""

# one period of the schedule, slot by slot: among the sources whose next block is
# released, the one whose next deadline is first, then the first by name
ORACLES["op10_mix_sources"] = """
with recursive rows_of as (select doc_id, source, coalesce('=' || source, 'null') as src, md5(coalesce(cast(doc_id as varchar), '')) as hashed from documents),
counts as (select src, count(*) as n, ceil(count(*) / 8.0)::bigint as blocks from rows_of group by src),
parts as (select src, blocks, 1 + floor(64 * sqrt(n / (max(n) over ())::double))::bigint as a, row_number() over (order by src) as i from counts),
shape as (select sum(a)::bigint as q, list(a order by i) as a, list(blocks order by i) as blocks, list(src order by i) as srcs from parts),
slots as (
  select 0::bigint as slot, list_transform(a, lambda x: 0::bigint) as served, 0::bigint as pick from shape
  union all
  select slot + 1, list_transform(served, lambda x, k: case when k = best then x + 1 else x end), best::bigint
  from (select slot, served, list_position(due, list_min(due)) as best
    from (select slot, served, list_transform(served, lambda x, k: case when x * q // a[k] <= slot then ((x + 1) * q + a[k] - 1) // a[k] end) as due
      from slots cross join shape where slot < q) s) t),
turns as (select slot - 1 as slot, pick, served[pick] - 1 as turn,
  list_transform(served, lambda x, k: case when k = pick then x - 1 else x end) as ahead from slots where slot > 0),
placed as (select doc_id, r.source, r.src, row_number() over (partition by r.src order by hashed, doc_id) - 1 as nth from rows_of r),
blocks as (select doc_id, source, nth // 8 as block, nth % 8 as mix_row, a, i from placed join parts using (src))
select b.doc_id, b.source,
  (1 + list_sum(list_transform(t.ahead, lambda x, k: least(s.blocks[k], (b.block // b.a) * s.a[k] + x))))::bigint as mix_position,
  b.mix_row::integer as mix_row
from blocks b join turns t on t.pick = b.i and t.turn = b.block % b.a cross join shape s"""
