"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lumenfuse.llm import line_dedup, mixing, ngram_join, substring_dedup

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size)::double as n, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select source, n, {mixing.MOST} * n as cap, case i % 3 when 0 then {mixing.WEIGHTS[0]} when 1 then {mixing.WEIGHTS[1]} else {mixing.WEIGHTS[2]} end::double as w from s),
f as (select *, {mixing.SHARE} * sum(n) over () - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0) as rest,
      sum(w) over (order by cap / w, source rows between current row and unbounded following) as free, row_number() over (order by cap / w, source) as r from w),
k as (select min(r) as r from f where rest * w / free < cap),
t as (select f.source, f.n::bigint as source_size, case when k.r is null or f.r < k.r then f.cap else c.rest * f.w / c.free end as target from f cross join k left join f c on c.r = k.r),
p as (select d.*, t.source_size, t.target, row_number() over () as row, sum(d.size) over (partition by d.source order by o, d.doc_id nulls first, d.size rows unbounded preceding) as ran from d join t on d.source is not distinct from t.source),
q as (select p.*, e.epoch, (ran + e.epoch * source_size) / target as finish from p cross join (select unnest(range({mixing.MOST})) as epoch) e where size > 0 and target > 0),
g as (select row, sum(size) over (order by finish, source nulls last, o, doc_id nulls first, epoch rows unbounded preceding) as reach from q),
n as (select row, count(*) as copies from g where reach <= (select sum(target) from t) group by row)
select doc_id, size, source_size, target, (size * coalesce(copies, 0))::bigint as taken from p left join n using (row)
"""

_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"
_CHAT = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p as (select *, lag(role) over w as was, lead(role) over w as next, row_number() over w as i from c window w as (partition by conv_id order by turn nulls first, role, text)),
l as (select *, length({_ESC.format("text")})
  + case when i = 1 or was <> role then 6 + length(replace(replace({_ESC.format("role")}, ':', '\c'), chr(10), '\n')) else 7 end
  + case when next is null or next <> role then 8 else 0 end as chars from p)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from l group by conv_id
"""

_URL = r"""
with c as (select page_id, url, date '2024-01-01' + (((page_id % 366) + 366) % 366)::int as fetched_at,
  nullif(regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.|\.+$', '', 'g'), '') as host,
  list_filter(string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') as segs from pages),
h as (select distinct host, ('0x' || substr(md5(host), 1, 7))::int as a, ('0x' || substr(md5(host), 8, 7))::int as b, ('0x' || substr(md5(host), 15, 7))::int as c from c where host is not null),
e as (select host as key, date '2024-01-01' + (b % 200)::int as d, 'block' as action from h where a % 3 = 0
  union all select host, date '2024-01-01' + (60 + b % 200 + c % 90)::int, 'drop' from h where a % 3 = 0 and c % 2 = 0
  union all select host || '/en', date '2024-01-01' + (c % 100)::int, 'allow' from h where a % 5 = 0
  union all values ('adult-x.example.com', date '2024-01-01', 'block'), ('example.org', date '2024-06-01', 'block'), ('example.org', date '2024-09-01', 'drop')),
e1 as (select key, d, min(action order by case action when 'block' then 0 when 'allow' then 1 else 2 end) as x, min(case action when 'block' then 0 when 'allow' then 1 else 2 end) as s from e group by key, d),
v as (select key, case s when 0 then 'block' when 1 then 'allow' else 'drop' end as action, d as valid_from, lead(d) over (partition by key order by d) as valid_to from e1),
k as (select page_id, fetched_at, array_to_string(string_split(host, '.')[i:], '.') as key, len(string_split(host, '.')) - i + 1 as weight from c, lateral (select unnest(range(1, len(string_split(host, '.')) + 1)) as i) where host is not null
  union all select page_id, fetched_at, host || '/' || array_to_string(segs[1:i], '/'), 1000 + i from c, lateral (select unnest(range(1, least(len(segs), 3) + 1)) as i) where host is not null),
m as (select page_id, max(struct_pack(weight := weight, key := k.key, action := action)) as b from k join v on k.key = v.key and action <> 'drop' and fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to) group by page_id)
select c.page_id, c.fetched_at, coalesce(b.action, 'keep') as verdict, b.key as rule from c left join m using (page_id)
"""

_REPEATS = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(doc_id, -9223372036854775808) as id, {_WORDS} as w from documents),
r as (select row, id, i, md5(array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ')) as h from d, lateral (select unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) as i)),
f as (select h, min(id) as first from r group by h having min(id) < max(id)),
g as (select distinct r.row, i + j as p from r join f on r.h = f.h and r.id > f.first, lateral (select unnest(range(0, {substring_dedup.WINDOW})) as j)),
u as (select row, unnest(w) as word, generate_subscripts(w, 1) as p from d),
k as (select u.row, string_agg(word, ' ' order by u.p) as kept, count(*) as n from u anti join g on u.row = g.row and u.p = g.p group by u.row)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (row)
"""

_JACCARD = rf"""
with recursive d as (select row_number() over () as row, doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
g as (select distinct row, array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ') as gram from d, lateral (select unnest(range(1, greatest(len(w) - {ngram_join.SHINGLE - 2}, least(len(w), 1) + 1))) as i)),
n as (select row, count(*) as n, md5(string_agg(gram, '|' order by gram)) as signature from g group by row),
c as (select row, count(*) over (partition by signature) as n_copies from n join d using (row) where doc_id is not null),
p as (select x.row as a, y.row as b, count(*) as shared from g x join g y on x.gram = y.gram and x.row <> y.row group by x.row, y.row),
e as (select distinct da.doc_id as x, db.doc_id as y from p join n na on na.row = a join n nb on nb.row = b join d da on da.row = a join d db on db.row = b where 100 * shared >= {ngram_join.PERCENT} * (na.n + nb.n - shared)),
r as (select distinct doc_id as x, doc_id as y from d where doc_id is not null union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, coalesce(c.n_copies, 1)::bigint as n_copies
from d left join n using (row) left join c using (row) left join m on m.x = d.doc_id
"""

_LINES = rf"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents where text is not null),
b as (select line, min(doc_id) as keeper from l where len(string_split_regex(trim(line), ' +')) >= {line_dedup.MIN_WORDS} group by line having count(distinct source) >= {line_dedup.MIN_SITES}),
f as (select l.line, min(p) as p from l join b on l.line = b.line and l.doc_id = b.keeper group by l.line),
x as (select l.doc_id, l.p, l.line, b.line is null or (l.doc_id = b.keeper and l.p = f.p) as stays from l left join b on l.line = b.line left join f on l.line = f.line),
y as (select doc_id, count(*) filter (not stays) as gone, coalesce(string_agg(line, chr(10) order by p) filter (stays), '') as t from x group by doc_id)
select d.doc_id, coalesce(gone, 0)::bigint as n_lines_removed, length(t)::bigint as kept_chars, md5(t) as kept_md5 from documents d left join y using (doc_id)
"""

# CRC-32 of a string of ASCII characters: a table by its rule, then one step a character.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x::bigint)) as t)"
_CRC = "xor(list_reduce(list_transform(string_split({}, ''), lambda s: ord(s)::bigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295)"

_REPAIR = rf"""
with recursive {_CRC_TABLE},
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as hit from conversations cross join crc),
d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from c, lateral (select unnest(range(case when hit = 3 then 2 else 1 end)) as time) where hit <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
n as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
  substr(role, 1, 1) as x, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as z from o),
f as (select *, case when z = '' then 'b' when again then 'd' when z not in ('.', '!', '?') then 't' else '' end as fault, lead(x) over (partition by conv_id order by i) as y from n),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
  count(*) filter (fault = 't') as truncated, count(*) filter (y is not null and x || y not in ('su', 'ua', 'au')) as illegal, max(i) as rows from f group by conv_id),
ins(a, pre, b) as (values (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
op(b, e, need, z) as (values (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', '', 2), (1, 'R', '', 2), (3, 'R', '', 2), (2, 'R', '', 3),
  (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3)),
dp as (select conv_id, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': ''}} as best from told
  union all
  select p.conv_id, p.i + 1, op.z, min({{'cost': p.best.cost + 3 * length(pre) + case e when 'D' then 4 when 'R' then 3 else 0 end + case when fault = 't' and e <> 'D' then 3 else 0 end, 'audit': p.best.audit || pre || e}})
  from dp p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1 join ins on ins.a = p.state join op on op.b = ins.b and (e = 'D' or fault not in ('b', 'd') and (e = 'R' or need = f.x))
  group by p.conv_id, p.i, op.z),
done as (select told.conv_id, min({{'cost': best.cost + 3 * length(pre), 'audit': best.audit || pre}}) as best from told join dp on dp.conv_id is not distinct from told.conv_id and dp.i = told.rows join ins on ins.a = dp.state and ins.b in (0, 3) group by told.conv_id),
l as (select conv_id, p, substr(best.audit, p, 1) as e, length(replace(substr(best.audit, 1, p), 'I', '')) as i, length(replace(substr(best.audit, 1, p), 'D', '')) as o
  from done, lateral (select unnest(range(1, length(best.audit) + 1)) as p)),
k as (select l.*, f.role, f.text, max(case when e = 'K' and f.x = 's' then 1 else 0 end) over (partition by l.conv_id) as sys from l left join f on f.conv_id is not distinct from l.conv_id and f.i = l.i and l.e <> 'I'),
h as (select conv_id, sha256(string_agg(case when e = 'K' then role when (o - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p)) as h from k where e <> 'D' group by conv_id)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(done.best.cost, 0) as cost, coalesce(done.best.audit, '') as audit, coalesce(h.h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a left join told on told.conv_id is not distinct from a.conv_id left join done on done.conv_id is not distinct from a.conv_id left join h on h.conv_id is not distinct from a.conv_id
"""

_TRIE = rf"""
with {_CRC_TABLE},
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select c, c - c % 100 as base, {_CRC.format("c::varchar")} % 6 as h from (select distinct c from t) cross join crc),
lent as (select ids.c, p, role, text from ids join t on t.c = ids.base and p <= h),
b as (select * from lent union all select t.c, p - h + coalesce(n, 0), role, text from t join ids using (c) left join (select c, count(*) as n from lent group by c) using (c) where p > h),
pre as (select c, p as d, string_agg(md5(role || chr(0) || text), '') over (partition by c order by p) as x, length(text) as chars from b union all select c, 0, '', 0 from ids),
m as (select c, d, chars, min(c) over (partition by d, x) as node, max(d) over (partition by c) = d as ends from pre),
n as (select node, d, count(*) as n_convs, any_value(chars) as chars, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from m group by node, d),
up as (select n.node, n.d, m.node as parent from n left join m on m.c = n.node and m.d = n.d - 1),
kids as (select parent as node, d - 1 as d, count(*) as n_children from up where d > 0 group by all),
w as (select n.*, up.parent, coalesce(n_children, 0) as n_children from n join up using (node, d) left join kids using (node, d)),
sums as (select m.node, m.d, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * w.chars)::bigint as saved_tokens from w join m on m.c = w.node and m.d <= w.d group by m.node, m.d)
select node as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from w join sums using (node, d)
"""

_NEAR = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as x, vec_id as y from embeddings union select reach.x, l.y from reach join l on l.x = reach.y),
c as (select x, min(y) as component_id from reach group by x), n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c on c.x = vec_id left join n on n.x = vec_id
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _JACCARD, "op2_mix_sources": _MIX, "op3_chat_format": _CHAT, "op6_url_filter": _URL, "op7_embedding_near_dedup": _NEAR, "op8_substring_dedup": _REPEATS, "op10_line_dedup": _LINES,
    "op12_conversation_repair": _REPAIR, "op13_prefix_trie": _TRIE,
}
