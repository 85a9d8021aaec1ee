"""Registered queries of the llm operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, embedding_dedup, exact_dedup, hard_negatives, langid, lm, mixing, ngram_join, suffix_dedup, token_count, url_filter,
               vector_codes, warc)
from .url_filter import Rule

#: (verdict, host, path)
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "net", "/de/"),
         Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), short=suffix_dedup.SHORT)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(noisy, noisy["vec_id"] % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_read(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_exact_dedup, op2_mix_sources, op3_lm_score, op4_warc, op5_url_filter, op6_decontaminate, op7_token_counts, op8_suffix_dedup, op9_language, op10_ngram_join,
    op11_hard_negatives, op12_vector_codes, op13_near_vectors)}

#: Vectors without a null or non-finite component.
_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
#: floor(256 * x); products of such integers are exact in doubles.
_INTS = "list_transform(embedding, lambda x: floor(256 * x::double))"


def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Rounds of assignment and means, one block of CTEs a round."""
    steps = [f"""
with v as materialized (
 select vec_id, label, {_INTS} as q from embeddings where {_WHOLE}
), x as materialized (
 select vec_id, p, q[p * w + 1:(p + 1) * w] as x from (select vec_id, q, (len(q) // {parts})::bigint as w, unnest(range({parts})) as p from v)
), b0 as materialized (
 select p, e, x as y from x join (select vec_id, row_number() over (order by vec_id) - 1 as e from v order by vec_id limit {entries}) f using (vec_id)
)"""]
    for k in range(rounds + 1):
        steps.append(f""", a{k} as materialized (
 select vec_id, x.p as p, arg_min(e, (d, e)) as e, min(d)::bigint as d, any_value(x) as x
 from (select vec_id, x.p, e, x, list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) as d from x join b{k} b on x.p = b.p) x group by vec_id, x.p
)""")
        if k < rounds:
            steps.append(f""", b{k + 1} as materialized (
 select b.p, b.e, coalesce(m.y, b.y) as y from b{k} b left join (
  select p, e, list(m order by i) as y from (
   select p, e, i, floor(sum(x[i]) / count(*)) as m from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{k}) group by p, e, i) group by p, e
 ) m on b.p = m.p and b.e = m.e
)""")
    return "".join(steps) + f""", c as (
 select vec_id, string_agg(lower(printf('%02x', e)), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id
), s as (
 select sha256(string_agg(n::bigint::varchar, ',' order by p, e, i)) as codebooks_sha256
 from (select p, e, unnest(y) as n, unnest(range(len(y))) as i from b{rounds})
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c join v using (vec_id), s
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
with d as (
 select doc_id, coalesce(length(text), 0) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), g as (
 select *, count(*) over (partition by norm) as group_size,
  first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
""",
    "op2_mix_sources": r"""
with base as (
 select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as w,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents
), s as (
 select source, sum(w)::double as size, row_number() over (order by source nulls last) as k from base group by source
), c as (
 select source, size, 2.0::double * size as cap, [5.0::double, 2.0::double, 1.0::double][((k - 1) % 3 + 1)::int] as wt from s
), f as (
 select *, sum(size) over () as t, sum(wt) over () as tw,
  coalesce(sum(cap) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as cap_b,
  coalesce(sum(wt) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as wt_b from c
), g as (
 select *, cap * (tw - wt_b) <= (1.5::double * t - cap_b) * wt as isfull from f
), r as (
 select *, sum(case when isfull then cap else 0.0::double end) over () as cap_f, sum(case when isfull then wt else 0.0::double end) over () as wt_f from g
), t as (
 select source, size, case when isfull then cap else (1.5::double * t - cap_f) / (tw - wt_f) * wt end as target from r
), n as (
 select *, case when size > 0 then floor(target / size) else 0 end as times from t
), x as (
 select b.doc_id, b.w, n.size, n.target, n.times, n.target - n.times * n.size as need,
  sum(b.w) over (partition by b.source order by b.h) as upto, sum(b.w) over (partition by b.source, b.h) as own
 from base b join n on b.source is not distinct from n.source
)
select doc_id, w as size, size::bigint as source_size, target,
 (w * (times + case when upto - own + own / 2.0::double <= need then 1 else 0 end))::bigint as taken from x
""",
    "op4_warc": r"""
with p as (
 select page_id, coalesce(html, '') as b, sha256(coalesce(html, '')) as d from pages
), f as (
 select *, strlen(b) as n, min(page_id) over (partition by b) as first from p
)
select page_id, n::bigint as payload_bytes, d as payload_digest,
 case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
 case when n >= 100 and page_id <> first then first end as refers_to from f
""",
    "op5_url_filter": rf"""
with p as (
 select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), r(verdict, rhost, rpath) as (
 values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), j as (
 select page_id, host, path, rhost || rpath as rule, verdict from p left join r
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from j
qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1
""",
    "op6_decontaminate": rf"""
with d as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
 select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), p as (
 select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
 from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)
), o as (
 select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
 from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from p) where len(w) >= n)
), m as (
 select doc_id, i, o.n, item_id from o join p on o.s = p.s and o.n = p.n
), h as (
 select doc_id, count(distinct k)::bigint as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from m) group by doc_id
), t as (
 select doc_id, count(*)::bigint as n_items, string_agg(x, ',' order by x) as x from (select distinct doc_id, item_id::varchar as x from m) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(x, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
""",
    "op11_hard_negatives": rf"""
with v as materialized (
 select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_INTS} as q from embeddings where label is not null and {_WHOLE}
), s as materialized (
 select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_dot_product(a.q, v.q)::bigint as score from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0
), p as (
 select anchor_id, vec_id as positive_id, score as positive_score from s where same
 qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
 select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
 from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op12_vector_codes": _codes_sql(),
    "op13_near_vectors": rf"""
with recursive v as materialized (
 select vec_id, list_transform(embedding, lambda x: x::double) as x,
  coalesce({_WHOLE} and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable from embeddings
), l as materialized (
 select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and a.usable and b.usable where list_cosine_similarity(a.x, b.x) >= 0.95
), r as (
 select vec_id as node, vec_id as root from v union select l.b, r.root from r join l on l.a = r.node
), c as (
 select node as vec_id, min(root) as component_id from r group by node
)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from c left join (select a as vec_id, count(*) as n from l group by a) using (vec_id)
""",
}
