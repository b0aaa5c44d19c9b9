"""DuckDB SQL for operators that SQL can express on small tables, by plain definitions: all windows, all pairs."""

from __future__ import annotations

from . import mixing
from .substrings import LEAST

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

#: Every byte string of LEAST bytes, counted; covered bytes are islands of window starts.
OP1 = rf"""
with d as (select row_number() over () as rn, doc_id, encode(coalesce(text, '')) as b from documents),
n as (select rn, doc_id, b, octet_length(b) as n from d),
x as (select rn, unnest(range(0, n - {LEAST} + 1)) as i, unnest(list_transform(range(0, n - {LEAST} + 1), lambda i: md5(b[i + 1:i + {LEAST}]))) as k from n where n >= {LEAST}),
r as (select rn, i from x where k in (select k from x group by k having count(*) > 1)),
g as (select *, case when i > lag(i) over (partition by rn order by i) + {LEAST} or lag(i) over (partition by rn order by i) is null then 1 else 0 end as new from r),
q as (select *, sum(new) over (partition by rn order by i) as run from g),
s as (select rn, run, min(i) as s, max(i) + {LEAST} as e from q group by rn, run),
k as (select rn, s, e, coalesce(lag(e) over (partition by rn order by s), 0) as before, lead(s) over (partition by rn order by s) as nxt from s),
p as (select rn, count(*) as n_spans, sum(e - s) as n_removed, string_agg(substr(hex(b), 2 * before + 1, 2 * (s - before)), '' order by s) as kept, max(e) as last from k join n using (rn) group by rn)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(hex(b), 2 * coalesce(last, 0) + 1))) as kept_sha256
from n left join p using (rn)"""

#: All pairs that share a shingle, by exact sets; components by following links.
OP3 = rf"""
with recursive w as (select row_number() over () as rn, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_WORD}') as w from documents),
s as (select distinct rn, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as g
  from (select rn, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
c as (select rn, count(*) as n from s group by rn),
p as (select a.rn as x, b.rn as y, count(*) as k from s a join s b on a.g = b.g and a.rn <> b.rn group by 1, 2),
l as (select x, y from p join c a on a.rn = x join c b on b.rn = y where 100 * k >= 75 * (a.n + b.n - k)),
t as (select rn as x, rn as y from w union select t.x, l.y from t join l on t.y = l.x)
select w.doc_id, coalesce(c.n, 0) as n_shingles, m.component_id, w.doc_id = m.component_id as kept
from w left join c using (rn) join (select t.x, min(v.doc_id) as component_id from t join w v on v.rn = t.y group by 1) m on m.x = w.rn"""

#: All pairs by cosine in double precision.
OP7 = """
with recursive v as (select row_number() over () as rn, vec_id, embedding::double[] as e from embeddings),
ok as (select *, sqrt(list_dot_product(e, e)) as n from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.rn as x, b.rn as y from ok a join ok b on a.rn <> b.rn and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
t as (select rn as x, rn as y from v union select t.x, l.y from t join l on t.y = l.x)
select v.vec_id, (select count(*) from l where l.x = v.rn) as n_links, m.component_id, v.vec_id = m.component_id as kept
from v join (select t.x, min(u.vec_id) as component_id from t join v u on u.rn = t.y group by 1) m on m.x = v.rn"""


def op5() -> str:
    """The mix without shortcuts: one running sum over each source, the tree level by level."""
    seed, most, tops, levels = mixing.SEED, mixing.MOST, mixing.TOP_UPS, mixing.LEVELS
    ups = "".join(
        f"""
b{k} as (select s, key, size from (select p.s, p.key, p.size, row_number() over (partition by p.s order by abs(h.short - p.size), p.size desc, p.key desc) as r
  from p join h{k} h using (s) where p.size > 0 and p.size < 2 * h.short and p.c > p.rest and not list_contains(h.more, p.key)) where r = 1),
h{k + 1} as (select s, short - coalesce(size, 0) as short, case when key is null then more else list_append(more, key) end as more from h{k} left join b{k} using (s)),"""
        for k in range(tops)
    )
    tree = "".join(
        f"""
n{k + 1} as (select s, in_pass, block, node * 2 + case when 2 * row_number() over (partition by node order by md5('{seed}:tree{k}:' || s || ':' || in_pass || ':' || block)) <= count(*) over (partition by node) then 0 else 1 end as node from n{k}),"""
        for k in range(levels)
    )
    return rf"""
with d as (select doc_id, case when source is null then '1' else '0' || source end as s, md5('{seed}:' || coalesce(doc_id::varchar, 'null')) as key,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
u as (select s, key, sum(size)::bigint as size from d group by 1, 2),
w as (select s, sum(size)::bigint as source_size, 1 + (row_number() over (order by s) - 1) % 3 as weight from u group by s),
l as (select *, (sum(source_size) over () - {most} * coalesce(sum(source_size) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as level
  from w window o as (order by source_size / weight, s rows between unbounded preceding and 1 preceding)),
t as (select *, case when source_size * {most} > level * weight then max(level) filter (source_size * {most} > level * weight) over () * weight else (source_size * {most})::double end as target from l),
q as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as passes from t),
z as (select *, floor(target)::bigint - passes * source_size as rest from q),
p as (select u.*, z.rest, z.passes, sum(u.size) over (partition by u.s order by u.key) as c from u join z using (s)),
h0 as (select s, any_value(rest) - coalesce(max(c) filter (c <= rest), 0) as short, []::varchar[] as more from p group by s),{ups}
e as (select s, any_value(passes) as passes, coalesce(min(substr(key, 1, 2)) filter (c > rest), '') as last from p group by s),
n0 as (select s, in_pass, lower(lpad(to_hex(b), 2, '0')) as block, 0 as node from (select *, unnest(range(1, passes + 2)) as in_pass from e) x, range(256) r(b)
  where in_pass <= passes or lower(lpad(to_hex(b), 2, '0')) <= last),{tree}
k as (select s, node, sum(count(*)) over (partition by s order by node) as upto, count(*) as quota from n{levels} group by s, node),
g as (select *, row_number() over (partition by s order by md5('{seed}:draw:' || s || ':' || in_pass || ':' || block)) as place from n0),
j as (select g.s, g.block, g.in_pass, k.node as shard from g join k on g.s = k.s and place > upto - quota and place <= upto),
m as (select s, key, max((c <= rest)::int) = 1 or any_value(list_contains(more, key)) as last from p join h{tops} using (s) group by s, key),
a as (select d.doc_id, d.s, d.key, d.size, z.source_size, z.target, z.passes, m.last, row_number() over () as rn from d join z using (s) join m using (s, key)),
r as (select x.rn, x.in_pass, coalesce(j.shard, 0) as shard from (select *, unnest(range(1, passes + case when last then 2 else 1 end)) as in_pass from a where size > 0) x
  left join j on j.s = x.s and j.block = substr(x.key, 1, 2) and j.in_pass = x.in_pass)
select doc_id, size, source_size, target, size * coalesce(n, 0) as taken, coalesce(shards, '') as shards
from a left join (select rn, count(*) as n, string_agg(shard::varchar, ',' order by in_pass) as shards from r group by rn) using (rn)"""
