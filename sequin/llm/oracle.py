"""DuckDB SQL for the queries that SQL can express, from the contracts alone."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
with recursive
d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         md5('1:' || coalesce(doc_id::varchar, '')) as key from documents),
s as materialized (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
total as (select sum(source_size)::double as total from s),
-- sources above three times their size stop there, and the rest is shared again, until none is above
share as (
  select 0 as round, source, false as capped from s
  union all
  select round + 1, source, capped or level * w >= 3.0 * source_size from (
    select share.*, s.w, s.source_size,
      (total - coalesce(sum(3.0 * source_size) filter (capped) over (), 0)) / sum(w) filter (not capped) over () as level
    from share join s on s.source is not distinct from share.source, total) q
  where round < (select count(*) from s)),
last as (select * from share where round = (select max(round) from share)),
t as (
  select s.*, case when capped then 3.0 * source_size
    else w * (total - coalesce(sum(3.0 * source_size) filter (capped) over (), 0)) / sum(w) filter (not capped) over () end::double as target
  from last join s on s.source is not distinct from last.source, total),
placed as (
  select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d)
-- the words that the mix takes of a source are the first of its stream, passed as often as needed
select p.doc_id, p.size, t.source_size, t.target,
  (greatest(0, least(p.size, g - p.start)) + greatest(0, least(p.size, g - t.source_size - p.start)) + greatest(0, least(p.size, g - 2 * t.source_size - p.start)))::bigint as taken
from placed p join (select *, floor(target + 0.5)::bigint as g from t) t on p.source is not distinct from t.source
"""

_OP2 = f"""
with recursive w as materialized (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
s as materialized (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
reach as (
  select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)
"""

_TAILS = r"SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|/ROLE\]|TEXT\]"
_OP5 = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\2\\\3', 'g'))
    + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7
      else 19 + length(regexp_replace(role, '([<\[])(\\*)({_TAILS})', '\1\2\\\3', 'g')) end as chars,
    lag(role) over (partition by conv_id order by turn, role, text) as was from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  bool_and(case role when 'system' then was is null when 'user' then was is null or was in ('system', 'assistant') when 'assistant' then was is not null and was = 'user' else false end)
    and arg_max(role, (turn, role, text)) <> 'system' as valid
from e group by conv_id
"""

_OP7 = """
with d as (select distinct doc_id, md5(text) as h, text from documents where text is not null),
l as (select doc_id, h, generate_subscripts(x, 1) - 1 as line, unnest(x) as t from (select doc_id, h, string_split(text, chr(10)) as x from d)),
w as (
  select {'known': doc_id is not null, 'id': coalesce(doc_id, 0), 'h': h, 'line': line} as place, doc_id, h, line,
    t as a, lead(t) over o as b, lead(t, 2) over o as c, lead(line, 2) over o as full_ from l window o as (partition by doc_id, h order by line)),
g as (
  select a, b, c, min(place) as first from w
  where full_ is not null and (length(trim(a, ' ')) > 0 or length(trim(b, ' ')) > 0 or length(trim(c, ' ')) > 0) group by all having count(*) > 1),
gone as (
  select distinct w.doc_id, w.h, w.line + i as line from w join g using (a, b, c), range(3) as x(i) where full_ is not null and w.place <> g.first),
n as (select doc_id, h, count(*) as n from gone group by all),
k as (
  select l.doc_id, l.h, string_agg(t, chr(10) order by l.line) as text from l
  left join gone on gone.doc_id is not distinct from l.doc_id and gone.h = l.h and gone.line = l.line where gone.line is null group by all)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n.n, 0)::bigint as n_removed,
  case when d.text is null then null else coalesce(k.text, '') end as text
from documents d left join n on n.doc_id is not distinct from d.doc_id and n.h = md5(d.text)
left join k on k.doc_id is not distinct from d.doc_id and k.h = md5(d.text)
"""

_OP9 = f"""
with t as (select doc_id, {_LOWER} as n from documents),
g as (select n, max(doc_id) as keep_id, count(*)::bigint as group_size from t group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from t join g using (n)
"""

_OP10 = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
g as (select h, max(page_id) as keep from p group by h)
select page_id, payload_bytes, sha1(h) as payload_digest,
  case when payload_bytes >= 1000 and page_id <> keep then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> keep then keep end as refers_to
from p join g using (h)
"""


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(state: str, letter: str, cost: str, role: str | None, text: str = "''") -> str:
    said = f"{state}.o || chr(10) || {role} || ':' || {text}" if role else f"{state}.o"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {said}}}"


def _if(condition: str, option: str) -> str:
    return f"case when {condition} then {option} else {_FAR} end"


_FAR = "{'c': 1000000000000::bigint, 'a': '', 'o': ''}"
_MORE = "(case when fault = 1 then 3 else 0 end)"
_USER, _ASSISTANT = "'user'", "'assistant'"
_keep = lambda state: _edit(state, "K", _MORE, "role", "text")
_rerole = lambda state, role: _edit(state, "R", f"3 + {_MORE}", role, "text")
_insert = lambda state, role: _edit(state, "I", "3", role)
_delete = lambda state: _edit(state, "D", "4", None)

# Forwards, row by row: for each state the least (cost, audit) that reaches it.
_OP11 = rf"""
with recursive
bytes as (select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as t),
k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (
  select k.* exclude (key), xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 as kind
  from k, bytes),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from h where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn from d),
f as (
  select *, left(role, 1) as i, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by rn) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(left(role, 1)) over (partition by conv_id order by rn) || left(role, 1) as pair from n),
r as materialized (
  select conv_id, rn, role, text, i, case when blank or again then 2 when cut then 1 else 0 end as fault from f),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
    count(*) filter (cut and not again and not blank) as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(rn) as n from f group by conv_id),
dp as (
  select conv_id, 0::bigint as rn, {{'c': 0::bigint, 'a': '', 'o': ''}} as s0, {_FAR} as s1, {_FAR} as s2, {_FAR} as s3 from counts
  union all
  select x.conv_id, x.rn, {_delete('s0')}, {_least(_delete('s1'), _if("fault < 2 and i = 's'", _keep('s0')))},
    {_least(_delete('u'), *[_if("fault < 2 and i = 'u'", _keep(s)) for s in ('s0', 's1', 'a')], *[_if('fault < 2', _rerole(s, _USER)) for s in ('s0', 's1', 'a')])},
    {_least(_delete('a'), _if("fault < 2 and i = 'a'", _keep('u')), _if('fault < 2', _rerole('u', _ASSISTANT)))}
  from (
    select r.conv_id, r.rn, role, text, i, fault, s0, s1, u1 as u, {_least('a1', _insert('u1', _ASSISTANT))} as a from (
      select dp.conv_id, dp.rn, s0, s1, {_least('s2', _insert('s0', _USER), _insert('s1', _USER), _insert('s3', _USER))} as u1, {_least('s3', _insert('s2', _ASSISTANT))} as a1 from dp) y
    join r on r.conv_id is not distinct from y.conv_id and r.rn = y.rn + 1) x),
e as (
  select counts.*, {_least('s0', 's3', _insert('s2', _ASSISTANT))} as best from dp join counts on counts.conv_id is not distinct from dp.conv_id and counts.n = dp.rn)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.o, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join e on e.conv_id is not distinct from i.conv_id
"""


def _op12(rounds: int = 6) -> str:
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select p.id, p.part, arg_min(b.e, {far}::hugeint * 16 + b.e) as e, min({far})::bigint as far from p join b{r} b using (part) group by all)""")
        if r < rounds:
            steps.append(f"""
m{r} as (
  select part, e, list((s - ((s % n) + n) % n) // n order by pos) as x from (
    select part, e, pos, sum(c)::bigint as s, count(*)::bigint as n from (select a.part, a.e, generate_subscripts(p.x, 1) as pos, unnest(p.x) as c from a{r} a join p using (id, part)) group by all) group by all),
b{r + 1} as materialized (select b.part, b.e, coalesce(m.x, b.x) as x from b{r} b left join m{r} m using (part, e))""")
    return f"""
with k as materialized (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as id, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::double)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as materialized (select id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] as x from k, range(8) as t(part)),
b0 as materialized (select part, id as e, x from p where id < 16), {','.join(steps)},
codes as (select id, string_agg(printf('%02x', e::int), '' order by part) as code, sum(far)::bigint as error from a{rounds} group by id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) from b{rounds}) as codebooks_sha256
from codes join k using (id)
"""


ORACLE: dict[str, str] = {
    "op1_mix_sources": _OP1,
    "op2_minhash_near_dedup": _OP2,
    "op5_chat_format": _OP5,
    "op7_line_windows": _OP7,
    "op9_exact_dedup": _OP9,
    "op10_warc": _OP10,
    "op11_repair_turns": _OP11,
    "op12_vector_codes": _op12(),
}
