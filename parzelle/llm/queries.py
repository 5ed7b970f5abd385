"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parzelle.llm import (debruijn, decontamination, hardnegatives, htmltext, licences, merkle,
                          mixing, quality, sharding, simhash, suffixes, tokencounts, toxicity)
from parzelle.llm.common import held_out, order_key, table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_words(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.examples(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(quality.examples(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs, rules)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark")).drop("digest")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        order_key(sharding.SEED).alias("key"))
    return sharding.interleave(docs, key="key").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.document_counts(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.learn(htmltext.examples(pages)))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = hardnegatives.usable(table(spark, sf_dir, "embeddings"),
                                F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hardnegatives.mine(rows, vec_id % 100 == 0)


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_debruijn": op2_debruijn,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_rules": op5_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_shards": op7_shards,
    "op8_token_counts": op8_token_counts,
    "op9_main_text": op9_main_text,
    "op10_suffixes": op10_suffixes,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_licences": op13_licences,
    "pipeline": corpus_pipeline.run,
}

SIZES = r"""
d as (select doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        md5(concat('17|', coalesce(doc_id::varchar, ''), '|', md5(coalesce(text, '')))) as key
      from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]
        as weight, sum(source_size) over () as total from s),
l as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as level from w),
c as (select *, cap * sum(weight) over (order by level, source nulls last
                  rows between current row and unbounded following)
             <= weight * (total - coalesce(sum(cap) over (order by level, source nulls last
                  rows between unbounded preceding and 1 preceding), 0)) as clamped from l),
t as (select source, source_size, case when clamped then cap else
        weight * (total::double - coalesce(sum(case when clamped then cap end) over (), 0))
        / sum(case when not clamped then weight end) over () end as target from c),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs,
        target - case when source_size > 0 then floor(target / source_size) else 0 end
                 * source_size as rest from t),
k as (select source, key, sum(size) as size, sum(sum(size)) over (partition by source order by key
        rows between unbounded preceding and current row) as until from d group by source, key)
"""

OP1 = f"""
with {SIZES}
select d.doc_id, d.size, p.source_size, p.target,
  ((p.epochs + case when p.rest > 0 and 2 * k.until - k.size <= 2 * p.rest then 1 else 0 end)
   * d.size)::bigint as taken
from d join p on d.source is not distinct from p.source
  join k on k.source is not distinct from d.source and k.key = d.key
"""

OP2 = r"""
with d as (select row_number() over () as rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as k
  from d, unnest(range(1, len(w) - 33)) t(i)),
gone as (select distinct rid, unnest(range(i, i + 35)) as pos
  from win where k in (select k from win group by k having count(*) > 1)),
word as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select rid, string_agg(x, ' ' order by pos) as t, count(*) as n
  from word anti join gone using (rid, pos) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid)
"""

OP6 = r"""
with tok as (
  select 'd' as kind, doc_id as id, text,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as t
  from (select distinct doc_id, text from documents)
  union all
  select 'b', item_id, text,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')
  from (select distinct item_id, text from benchmark)),
-- where a fifth of the words at most differ, two neighbours are equal (the word of an item
-- of one word); every such diagonal is tried, without any mask
word as (select kind, id, text, i, t[i + 1] || ' ' || t[i + 2] as w
    from (select *, unnest(range(0, len(t) - 1)) as i from tok)
  union all
  select kind, id, text, i, t[i + 1] from (select *, unnest(range(0, len(t))) as i from tok
    where kind = 'd' or len(t) = 1)),
hit as (select distinct d.id as doc_id, d.text as doc, b.id as item_id, b.text as item, d.i - b.i as g
  from word d join word b on d.kind = 'd' and b.kind = 'b' and d.w = b.w),
pair as (select h.doc_id, h.doc, h.item_id, h.g, d.t as td, b.t as tb,
    greatest(0, -h.g) as lo, least(len(b.t), len(d.t) - h.g) as hi, least(12, len(b.t)) as w
  from hit h join tok d on d.kind = 'd' and d.id is not distinct from h.doc_id
      and d.text is not distinct from h.doc
    join tok b on b.kind = 'b' and b.id is not distinct from h.item_id
      and b.text is not distinct from h.item),
flag as (select *, hi - lo as n_overlap,
    list_transform(range(lo, hi), lambda j: case when td[j + g + 1] = tb[j + 1] then 1 else 0 end) as f
  from pair),
score as (select *, list_sum(f)::int as n_equal, case when n_overlap >= w then
    list_max(list_transform(range(0, n_overlap - w + 1), lambda j: list_sum(f[j + 1:j + w])))::int else 0 end
    as best_window from flag),
best as (select *, row_number() over (partition by doc_id, doc, item_id
    order by best_window desc, n_equal desc, lo + g, n_overlap desc) as r
  from score where best_window >= 0.8 * w or (n_overlap >= 12 and n_equal >= 0.8 * n_overlap))
select doc_id, item_id, len(tb)::int as n_item, n_overlap::int as n_overlap, n_equal, best_window,
  (lo + g)::int as doc_start from best where r = 1
"""

OP7 = r"""
with tab as (select list_transform(range(0, 256), lambda i: list_reduce(
      list_concat([i], range(0, 8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, source, hex(encode(coalesce(text, ''))) as h,
    md5(concat('29|', coalesce(doc_id::varchar, ''), '|', md5(coalesce(text, '')))) as key
  from documents),
r as (select *, row_number() over (partition by source order by key) as rank,
    count(*) over (partition by source) as n,
    dense_rank() over (order by source nulls last) as s from d),
m as (select *, row_number() over (order by (2 * rank - 1) / (2.0::double * n), s) - 1 as at_,
    count(*) over () as total from r),
p as (select *, total // 16 as each, total % 16 as larger from m),
q as (select *, case when at_ < larger * (each + 1) then at_ // (each + 1)
    else larger + (at_ - larger * (each + 1)) // greatest(each, 1) end as shard from p)
select doc_id, (len(h) // 2 + 1)::bigint as size,
  xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2),
    lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32,
  'rows' as law, shard::int as shard, (at_ - shard * each - least(shard, larger))::bigint as slot,
  null::int as grown_shard
from q, tab
"""

OP11 = """
with recursive tab as (select list_transform(range(0, 256), lambda i: list_reduce(
      list_concat([i], range(0, 8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as rid, *, xor(list_reduce(list_concat([4294967295],
      list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 as hit
    from documents, tab),
f as (select rid, doc_id, lang, concat(
      coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
      text, case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        else text end as shown from d),
leaf as (select rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
      sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) as shown from f),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place,
      count(*) over (partition by lang) as n from leaf),
lv as (select lang, 0 as level, place, leaf as node, n from placed
  union all
  select lang, level + 1, place // 8, sha256(string_agg(node, '' order by place)), (n + 7) // 8
  from lv where n > 1 group by lang, level, place // 8, n),
sub as (select lang, node as subroot, level as height,
      row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n
    from lv where n = 1),
tv as (select 0 as level, place, subroot as node, n from sub
  union all
  select level + 1, place // 8, sha256(string_agg(node, '' order by place)), (n + 7) // 8
  from tv where n > 1 group by level, place // 8, n),
step as (
  select p.rid, s.level, coalesce(string_agg(s.node, '' order by s.place)
        filter (where s.place < p.place // (8 ** s.level)::bigint), '') as l,
      coalesce(string_agg(s.node, '' order by s.place)
        filter (where s.place > p.place // (8 ** s.level)::bigint), '') as r
  from placed p join lv s on s.lang is not distinct from p.lang and s.n > 1
    and s.place // 8 = p.place // (8 ** (s.level + 1))::bigint group by p.rid, s.level
  union all
  select p.rid, b.height + s.level, coalesce(string_agg(s.node, '' order by s.place)
        filter (where s.place < b.place // (8 ** s.level)::bigint), ''),
      coalesce(string_agg(s.node, '' order by s.place)
        filter (where s.place > b.place // (8 ** s.level)::bigint), '')
  from placed p join sub b on b.lang is not distinct from p.lang join tv s on s.n > 1
    and s.place // 8 = b.place // (8 ** (s.level + 1))::bigint group by p.rid, b.height, s.level),
fold as (select rid, 0 as level, shown as node from placed
  union all
  select rid, level + 1, sha256(l || node || r) from fold join step using (rid, level)),
proof as (select rid, string_agg(l || r, '' order by level) as t, count(*) as steps from step group by rid)
select p.doc_id, p.leaf, b.subroot, (select node from tv where n = 1) as root,
  sha256(coalesce(q.t, '')) as proof_sha256, f.node as folded_root,
  f.node = (select node from tv where n = 1) as verified
from placed p join sub b on b.lang is not distinct from p.lang
  left join proof q using (rid) join fold f on f.rid = p.rid and f.level = coalesce(q.steps, 0)
"""

OP12 = """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
    list_inner_product(a.e, r.e)::bigint as score
  from v a join v r on a.vec_id % 100 = 0 and (r.vec_id, r.label, r.e) is distinct from (a.vec_id, a.label, a.e)),
p as (select * from pair where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.anchor_id, p.vec_id
    order by n.score desc, n.vec_id))::int as rank, n.vec_id as negative_id,
  p.score as positive_score, n.score as negative_score
from p join pair n on n.anchor_id = p.anchor_id and not n.same
  and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""

def _listed(items) -> str:
    return "[" + ", ".join("'" + w + "'" for w in items) + "]"


OP13_TEMPLATES = ",\n  ".join(
    f"({i}, '{label}', {_listed(licences.words(text))}, "
    f"[{', '.join(_listed(licences.words(p)) for p in phrases)}])"
    for i, (label, text, phrases) in enumerate(licences.TEMPLATES))
OP13_BASE = ", ".join(f"('{label}', {_listed(licences.words(phrase))})" for phrase, label in licences.BASE)
OP13 = rf"""
with tpl(tid, label, w, phrases) as (values {OP13_TEMPLATES}),
base(label, w) as (values {OP13_BASE}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{licences.UPPER}', '{licences.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
post as (select tid, unnest(w) as word, unnest(range(0, len(w))) as q from tpl),
place as (select rid, word, f from (select rid, unnest(w) as word, unnest(range(0, len(w))) as f from d)
  where word in (select word from post)),
df as (select word, count(distinct rid) as n from place group by word),
has as (select distinct rid, tid, word, n from place join (select distinct tid, word from post) using (word)
  join df using (word)),
looked as (select * from has qualify row_number() over (partition by rid, tid order by n, word) <= {licences.LOOKED_UP}),
hit as (select l.rid, l.tid, l.word, f - q as begins from looked l join place p on p.rid = l.rid
  and p.word = l.word join post o on o.tid = l.tid and o.word = l.word),
size as (select tid, len(w) as n, ceil(least({licences.LOOKED_UP}, len(list_distinct(w))) / 2.0) as needed from tpl),
band as (select rid, tid, shift, floor((begins + shift) / {licences.BAND}.0)::bigint as b
  from hit join size using (tid) cross join (values (0), ({licences.BAND // 2})) s(shift)
  group by rid, tid, shift, b, needed having count(distinct word) >= needed),
span as (select rid, tid, greatest(0, b * {licences.BAND} - shift) as lo,
    b * {licences.BAND} - shift + {licences.BAND - 1} + n as hi from band join size using (tid)),
part as (select s.rid, s.tid, d.w[s.lo + 1:s.hi] as w, t.w as tw, t.label, t.phrases
  from span s join d using (rid) join tpl t using (tid) where s.hi > s.lo),
verified as (select rid, label, list_sum(list_transform(list_distinct(tw), lambda x: least(
      len(list_filter(tw, lambda y: y = x)), len(list_filter(w, lambda y: y = x))))) / len(tw)::double as share
  from part where len(list_filter(phrases, lambda p: len(list_filter(range(1, len(w) - len(p) + 2),
      lambda i: w[i:i + len(p) - 1] = p)) = 0)) = 0),
found as (select rid, b.label, f from (select rid, unnest(range(0, len(w))) as f, w from d
    where len(w) > 0) x join base b on x.w[f + 1] = b.w[1] and x.w[f + 1:f + len(b.w)] = b.w),
sums as (select rid, count(*) as n, min(f) as lo, max(f) as hi,
    string_agg(distinct label, ',' order by label) as labels from found group by rid),
best as (select rid, max(share) as share from verified where share >= {licences.LEAST_SHARE} group by rid),
every as (select rid, string_agg(distinct label, ',' order by label) as labels from (
    select rid, label from found union all
    select rid, label from verified where share >= {licences.LEAST_SHARE}) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(s.n, 0)::bigint as n_base, s.lo as first_word,
  s.hi as last_word, coalesce(s.labels, '') as base_labels, coalesce(e.labels, '') as labels,
  case when e.labels is null then 0.0::double else 0.5::double + 0.5::double * coalesce(b.share, 0) end as score
from d left join sums s using (rid) left join every e using (rid) left join best b using (rid)
"""

ORACLES = {
    "op13_licences": OP13,
    "op12_hard_negatives": OP12,
    "op11_merkle": OP11,
    "op1_mix": OP1,
    "op2_debruijn": OP2,
    "op6_decontaminate": OP6,
    "op7_shards": OP7,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
