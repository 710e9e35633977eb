"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_MIX = r"""
with d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as weight
  from d group by source
), f as (
  select *, 3 * source_size as cap,
         row_number() over (order by (3 * source_size)::double / weight::double, weight, source is null, source) as n
  from s
), l as (
  select *, ((sum(source_size) over ())
             - coalesce(sum(cap) over (order by n rows between unbounded preceding and 1 preceding), 0))::double
          / ((sum(weight) over ())
             - coalesce(sum(weight) over (order by n rows between unbounded preceding and 1 preceding), 0))::double as level
  from f
), t as (
  select source, source_size, least(cap::double,
           weight::double * (select arg_min(level, n) from l where level * weight::double <= cap::double)) as target,
         (('0x' || substr(md5(coalesce(source, '')), 1, 8))::bigint % 9 - 4)::double / 5.0::double as slope
  from l
), r as (
  select d.doc_id, d.size, t.source_size, t.target, t.slope, floor(t.target)::bigint as goal,
         (sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.size, d.doc_id
                            rows unbounded preceding) - d.size)::bigint as ahead
  from d join t on d.source is not distinct from t.source
), p as (
  select *, list_transform([0, 1, 2], lambda k: greatest(0, least(size, goal - k * source_size - ahead))) as parts from r
), q as (
  select *, list_sum(parts)::bigint as taken,
         (case when parts[1] > 0 then ahead::double / greatest(goal, 1)::double end) as x,
         1.0::double - slope as b
  from p
)
select doc_id, size, source_size, target, taken,
       case when x is null then null when x <= 0 then 0.0::double
            else least(1.0::double, 2 * x / (b + sqrt(greatest(b * b + 4 * slope * x, 0.0::double)))) end as position
from q
"""

_TOP_K = """
with v as (
  select vec_id, [floor(256.0::double * x::double)::bigint for x in embedding] as c
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(c.c, lambda a, i: a * q.c[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.c) = len(c.c)
)
select query_id, rank, vec_id, score from (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
) where rank <= 5
"""

_WINNOW = r"""
with dw as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), bw as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null
), iw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from bw where len(w) > 0)
), dp as (
  select k, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from iw) where len(w) >= n)
), hit as (
  select dp.k, dp.i, dp.n, iw.item_id from dp join iw on dp.n = iw.n and dp.win = iw.win
), items as (
  select k, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids
  from hit group by k
), words as (
  select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) group by k
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join items using (k) left join words using (k)
"""

_VARIANTS = r"""
with recursive steps as (
  select range::bigint as b, range::bigint as c, 0 as k from range(256)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), lut as (
  select list(c order by b) as t from steps where k = 8
), runs as (
  select coalesce(doc_id::varchar, '') as id, count(*)::bigint as n,
         translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
  group by all
), hashed as (
  select w, n, xor(4294967295, list_reduce(
           list_transform(string_split(id || ':', ''), lambda c: ord(c)::bigint)
           || flatten(list_transform(string_split(w, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end)),
           lambda crc, x: xor(crc >> 8, t[xor(crc, x) % 256 + 1]), 4294967295::bigint)) as h
  from runs, lut
), words as (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed
  ) where length(word) >= 6 group by word having sum(n) >= 5
), cuts as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as near, b.n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.rest = b.word
), best as (
  select word, count(*)::bigint as n_near, max(n) as top from near group by word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near,
         (select min(x.near) from near x where x.word = w.word and x.n = b.top and b.top >= 5 * w.n) as form,
         case when b.top >= 5 * w.n then b.top end as form_n
  from words w left join best b using (word)
), walk as (
  select word, word as root, form as next from forms
  union all
  select walk.word, walk.next, forms.form from walk join forms on forms.word = walk.next
)
select f.word, f.n, f.n_near, f.form, f.form_n, r.root
from forms f join (select word, root from walk where next is null) r on r.word = f.word
"""

_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256.0::double * x::double)::bigint for x in embedding] as c
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike,
         coalesce(list_sum(list_transform(c.c, lambda x, i: x * a.c[i])), 0)::bigint as score
  from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id and len(a.c) = len(c.c)
), p as (
  select * from (
    select anchor_id, vec_id as positive_id, score as positive_score,
           row_number() over (partition by anchor_id order by score desc, vec_id) as k
    from s where alike
  ) where k <= 5
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.alike
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
) where rank <= 3
"""

_WORD_REPEATS = r"""
with d as (
  select row_number() over () as k, doc_id, coalesce(doc_id, 9223372036854775807) as o,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), win as (
  select k, o, i, array_to_string(w[i:i + 19], ' ') as t
  from (select k, o, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
), later as (
  select k, i from (
    select k, i, o, first_value(o) over g as o1, first_value(i) over g as i1 from win window g as (partition by t order by o, i)
  ) where o <> o1 or i <> i1
), gone as (
  select distinct k, unnest(range(i, i + 20)) as p from later
), words as (
  select k, unnest(w) as t, generate_subscripts(w, 1) as p from d
), kept as (
  select k, count(*)::bigint as n, string_agg(t, ' ' order by p) as body from words anti join gone using (k, p) group by k
)
select doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from d left join kept using (k)
"""

ORACLES = {
    "op6_curriculum_mix": _MIX, "op8_ball_tree_top_k": _TOP_K, "op10_winnowing": _WINNOW,
    "op11_spelling_variants": _VARIANTS, "op12_hard_negatives": _NEGATIVES, "op13_substring_dedup": _WORD_REPEATS,
}
