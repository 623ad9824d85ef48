"""DuckDB SQL of the training-text queries that SQL can express, over whole tables."""

from __future__ import annotations

_CUTS = [(size, k) for size in (2, 3, 4) for k in range(1, size)]

#: Every n-gram of every piece is listed and counted; cuts and longer candidates are joined by their text.
COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
  from (select lang, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from words, (values (1), (2), (3), (4)) as s(size))),
f as (select lang, size, phrase, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
candidates as (select lang, size, phrase, string_split(phrase, ' ') as w, a from f where size > 1 and a >= 30),
inside as (
  select c.lang, array_to_string(list_slice(w, i, i + s - 1), ' ') as phrase, max(a) as most
  from (select *, unnest(generate_series(1, size - s + 1)) as i from candidates, (values (2), (3)) as t(s) where s < size) as c group by all),
alone as (
  select c.* from candidates as c left join inside as i using (lang, phrase) where i.most is null or 100::hugeint * i.most < 80::hugeint * c.a),
cuts as (
  {" union all ".join(f"select lang, phrase, a, {k} as k, array_to_string(list_slice(w, 1, {k}), ' ') as p, array_to_string(list_slice(w, {k + 1}, {size}), ' ') as q from alone where size = {size}" for size, k in _CUTS)}),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, ((2000000::hugeint * c.a) // (l.a + r.a))::bigint as score
  from cuts as c join f as l on l.lang = c.lang and l.phrase = c.p join f as r on r.lang = c.lang and r.phrase = c.q),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) join n using (lang) where rank <= 2000"""

#: Every query against every other row of its length, in exact integers.
VECTOR_TOPK = """
with x as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
scores as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from x as q join x as c on c.vec_id is distinct from q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5"""
