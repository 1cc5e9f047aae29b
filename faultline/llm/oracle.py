"""DuckDB statements equal to the operators' queries, where SQL can express them."""

from __future__ import annotations

from faultline.llm.queries import LISTED_LABELS

WORDS = r"[^\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LABELS = ", ".join(f"'{w}'" for w in LISTED_LABELS)

OP1 = rf"""
with parts as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {AZ}) as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
         regexp_replace(regexp_replace(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '') as query
  from pages),
canon as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
              || case when path = '' then '/' else path end || case when query = '' then '' else '?' || query end end as canonical
  from parts),
listed as (select distinct canonical from canon where list_has_any(regexp_split_to_array(host, '[.-]'), [{_LABELS}]) and canonical is not null),
ruled as (
  select c.*, l.canonical is not null as listed,
         case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from canon c left join listed l using (canonical))
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict,
       listed
from ruled
"""

OP4 = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when first_id is not null and page_id <> first_id then first_id end as refers_to
from p left join g using (payload_digest)
"""

OP10 = rf"""
with d as (select doc_id, source, md5(coalesce(text, '')) as own, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select source, source_size, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight from s),
-- sources in the order in which they reach their cap; the level that holds is the first that caps no further one
o as (select *, 2.0 * source_size / weight as caps_at,
             coalesce(sum(source_size) over (order by 2.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before_size,
             sum(weight) over (order by 2.0 * source_size / weight, source nulls last rows between current row and unbounded following) as free_weight,
             sum(source_size) over () as total
      from w),
l as (select min_by((1.5 * total - 2.0 * before_size) / free_weight, caps_at) as level from o where caps_at > (1.5 * total - 2.0 * before_size) / free_weight),
t as (select source, source_size, least(2.0::double * source_size, (select level from l)::double * weight) as target from w),
r as (select doc_id, own, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate
      from d join t on d.source is not distinct from t.source),
c as (select *, ('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null') || ':' || own), 1, 13))::bigint / 4503599627370496.0::double as draw from r)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast((floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken
from c
"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = rf"""
with b as (select item_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{ALNUM}'), []) as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as k
        from b where len(w) > 0),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{ALNUM}'), []) as w from documents),
runs as (select doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') as k
         from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from d, (select distinct size from win) where len(w) >= size)),
found as (select distinct doc_id, size, s, k from runs where k in (select k from win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from found) group by doc_id),
held as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
         from (select distinct doc_id, cast(item_id as varchar) as item from found join win using (k)) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join held using (doc_id)
"""

OP8 = rf"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) as w from documents),
pos as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20),
win as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from pos),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as rn from win) where rn > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from again)),
word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
kept as (select doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by p) filter (g.p is null) as kept
         from word left join gone g using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""

OP9 = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{WORDS}'), []) as w from documents),
sh as (select distinct doc_id, s from (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             when len(w) > 0 then ['<' || len(w) || '> ' || array_to_string(w, ' ')] else [] end) as s from d)),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways as (select a, b from links union select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select reach.doc_id, b from reach join both_ways on other = a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by 1) c using (doc_id)
"""

OP11 = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score from v q join v c on q.r <> c.r where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

# unsigned crc32 of a decimal doc_id; 3988292384 is the polynomial of crc32 (fixed value)
CRC32 = ("xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), "
         "lambda a, c: list_reduce(range(8), lambda b, i: xor(b >> 1, (b & 1) * 3988292384), xor(a, c)), 4294967295::bigint), 4294967295)")


def _leaf(text: str) -> str:
    values = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text]
    return "sha256(" + " || ".join(f"coalesce(cast(octet_length(encode({v})) as varchar) || ':' || {v}, '-')" for v in values) + ")"


OP13 = f"""
with recursive l as (select row_number() over () as r, doc_id, lang, {_leaf("text")} as leaf, {_leaf(f"translate(text, {AZ})")} as lowered, coalesce({CRC32} % 3 = 0, false) as hit from documents),
ranked as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as size from l),
nodes(tree, level, idx, size, digest) as (
  select tree, 0, idx, size, leaf from ranked
  union all select tree, level + 1, idx // 8, max(size + 7) // 8, sha256(string_agg(digest, '' order by idx)) from nodes where size > 1 group by tree, level, idx // 8),
sub as (select tree, digest as subroot, level as height from nodes where size = 1),
tops(level, idx, size, digest) as (
  select 0, tree, (select count(*) from sub), subroot from sub
  union all select level + 1, idx // 8, max(size + 7) // 8, sha256(string_agg(digest, '' order by idx)) from tops where size > 1 group by level, idx // 8),
every as (select tree, level, idx, size, digest from nodes union all select -1, level, idx, size, digest from tops),
runs as (select tree, level, idx // 8 as run, list(digest order by idx) as own from every where size > 1 group by all),
path(r, tree, level, idx, folded, others) as (
  select r, tree, 0, idx, case when hit then lowered else leaf end, '' from ranked
  union all
  select r, case when own is null then -1 else p.tree end, case when own is null then 0 else p.level + 1 end, case when own is null then p.tree else p.idx // 8 end,
         case when own is null then folded else sha256(array_to_string(list_concat(own[:p.idx % 8], [folded], own[p.idx % 8 + 2:]), '')) end,
         case when own is null then others else others || array_to_string(list_concat(own[:p.idx % 8], own[p.idx % 8 + 2:]), '') end
  from path p left join runs on runs.tree = p.tree and runs.level = p.level and runs.run = p.idx // 8
  where p.tree >= 0 or own is not null),
ends as (select r, folded, others from (select *, row_number() over (partition by r order by tree, level desc) as k from path) where k = 1)
select doc_id, leaf, subroot, top.digest as root, sha256(others) as proof_sha256, folded as folded_root, folded = top.digest as verified
from ranked join sub using (tree) join ends using (r) cross join (select digest from tops where size = 1) as top
"""

ORACLE = {"op1_url_filter": OP1, "op3_decontamination": OP3, "op4_warc": OP4, "op8_substring_dedup": OP8, "op9_jaccard_join": OP9, "op10_mixing": OP10, "op11_kd_search": OP11, "op13_merkle_manifest": OP13}
