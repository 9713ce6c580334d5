"""DuckDB SQL of greedy folds, splits and redaction, as the registry's queries need it: common table expressions that
follow those of views and registry, and whole statements."""

from __future__ import annotations

from engramlake.functions import text as T
from engramlake.plans.views import NOW

WORDS = (
    "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),"
    f" lambda w: length(w) >= 4 and w not in ({', '.join(map(repr, T.TOPIC_STOP))}) and not regexp_full_match(w, '[0-9]+'))"
)


def quoted(pattern: str, any_case: bool = False) -> str:
    return "'" + ("(?i)" if any_case else "") + pattern.replace("'", "''") + "'"


# --- chunks and units --------------------------------------------------------------------------------------------

_STRIPPED = "regexp_replace(regexp_replace({0}, '^[\\x09-\\x0D ]+', ''), '[\\x09-\\x0D ]+$', '')"
_HELD = "(case when s.n = 0 then x.held else s.held || chr(10) || x.held end)"
_START = "(case when s.n = 0 then x.start else s.start end)"
_LENGTH = "(s.n + length(x.held) + 1)"
_FULL = f"({_LENGTH} >= 900 and trim(x.held, ' ') = '' or {_LENGTH} >= 1200)"


def _put(done: str, held: str, start: str) -> str:
    kept = _STRIPPED.format(held)
    return f"(case when {kept} = '' then {done} else list_append({done}, {{'start': {start}, 'text': {kept}}}) end)"


CHUNKS = f"""
with lines as (select doc_id, list_transform(string_split(text, chr(10)), lambda x, i:
    {{'held': x, 'n': 0::bigint, 'start': i::bigint, 'done': []::struct(start bigint, "text" varchar)[]}}) as l
  from documents where text is not null),
folded as (select doc_id, list_reduce(l, lambda s, x: {{
    'held': case when {_FULL} then '' else {_HELD} end, 'n': case when {_FULL} then 0 else {_LENGTH} end,
    'start': case when {_FULL} then 0 else {_START} end, 'done': case when {_FULL} then {_put("s.done", _HELD, _START)} else s.done end}},
    {{'held': '', 'n': 0::bigint, 'start': 0::bigint, 'done': []::struct(start bigint, "text" varchar)[]}}) as f from lines),
whole as (select doc_id, {_put("f.done", "f.held", "f.start")} as c from folded)
select doc_id, n::int as n, c[n + 1].start::int as start_line, md5(c[n + 1].text) as text_md5 from whole, unnest(range(len(c))) as u(n)"""

_PACKED = f"(length(s.held) + 1 + length(x.held) > {T.MAX_CHARS} and s.held <> '')"
UNITS = f"""
said as (select '/threads/' || conv_id || '.jsonl' as file, turn + 1 as line, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations
  where not regexp_matches(text, '(?i)<NO-RECALL>')),
sentences as (select *, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {{'held': x, 'done': []::varchar[]}}) as l from said where length(text) >= {T.MIN_CHARS}),
packed as (select file, line, role, text, list_reduce(l, lambda s, x: {{
    'held': case when {_PACKED} or s.held = '' then x.held else s.held || ' ' || x.held end,
    'done': case when {_PACKED} then list_append(s.done, trim(s.held)) else s.done end}}, {{'held': '', 'done': []::varchar[]}}) as f from sentences),
cut as (select file, line, role, case when length(text) <= {T.MAX_CHARS} then [text] else flatten(list_transform(
    case when trim(f.held) = '' then f.done else list_append(f.done, trim(f.held)) end,
    lambda p: list_transform(range(greatest((length(p) - 1) // {T.MAX_CHARS}, 0) + 1), lambda k: substr(p, k * {T.MAX_CHARS} + 1, {T.MAX_CHARS})))) end as p from packed),
units as (select file, line, role, (i - 1)::int as sub, p[i] as text, left(sha1(file || ':' || line || ':' || (i - 1) || ':' || left(p[i], 80)), 16) as id
  from cut, unnest(range(1, len(p) + 1)) as u(i) where length(p[i]) >= {T.MIN_CHARS})"""

SIGNALS = f"""
with said as (select '/threads/' || conv_id || '.jsonl:' || lpad((turn + 1)::varchar, 6, '0') as ord, role,
    case when role = 'user' then 'We decided to keep /threads/' || conv_id || '.jsonl for now. ' else '' end || text as text from conversations),
split as (select ord, role, string_split(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)) as l from said),
lines as (select ord, role, n, trim(l[n], ' ') as text from split, unnest(range(1, len(l) + 1)) as u(n)),
tagged as (select *, list_filter([{", ".join(f"case when regexp_matches(text, {quoted(p, True)}) then {n!r} end" for n, p in T.MARKERS)}], lambda x: x is not null) as tags
  from lines where length(text) between 12 and 400),
first as (select *, row_number() over (partition by left(lower(text), 120) order by ord, n) as r from tagged where len(tags) > 0)
select row_number() over (order by ord, n) - 1 as pos, role, text, array_to_string(tags, ',') as tags from first where r = 1 order by ord, n limit 40"""

POLARITY = f"""
select doc_id, regexp_matches(text, {quoted(T.DENIES, True)}) as denies, regexp_matches(text, {quoted(T.FAVOURS, True)}) as favours from documents"""


def redaction(source: str = "documents") -> str:
    """CTEs t0, t1 ... of (doc_id, text, redacted): after each rule."""
    parts = [f"t0 as (select doc_id, text, 0 as redacted from {source})"]
    for k, (shape, any_case, with_) in enumerate(T.SECRETS, 1):
        new = f"regexp_replace(text, {quoted(shape, any_case)}, {quoted(with_.replace('$1', chr(92) + '1'))}, 'g')"
        parts.append(f"t{k} as (select doc_id, {new} as text, redacted + len(regexp_extract_all(text, {quoted(shape, any_case)}))::int as redacted from t{k - 1})")
    return ",\n".join(parts)


REDACTED = f"with {redaction()}\nselect doc_id, md5(text) as text_md5, redacted from t{len(T.SECRETS)} where redacted > 0"

# --- greedy folds over the graph ---------------------------------------------------------------------------------

#: Over w (a, b, sim, days, shared, s, t, e): edges that a scan from the strongest keeps while both ends have fewer than 8.
CAPPED = """
edge as (select a, b, sim, days, shared::bigint as shared, round(least(1, 0.60::double * s + 0.25::double * t + 0.15::double * e), 6) as weight,
    array_to_string(list_filter([case when s > 0 then 'semantic' end, case when t > 0 then 'temporal' end, case when e > 0 then 'entity' end], lambda x: x is not null), ' + ') as reason
  from w where round(0.60 * s + 0.25 * t + 0.15 * e, 6) > 0),
placed as (select *, row_number() over (order by weight desc, a, b) as k from edge),
scan as (select list({'a': a + 1, 'b': b + 1, 'k': k, 'degree': []::int[], 'kept': []::bigint[]} order by k) as l from placed),
walked as (select list_reduce(l, lambda s, x: case when s.degree[x.a] < 8 and s.degree[x.b] < 8 then {'a': 0, 'b': 0, 'k': 0,
    'degree': list_transform(s.degree, lambda d, i: d + (i = x.a or i = x.b)::int), 'kept': list_append(s.kept, x.k)} else s end,
    {'a': 0::bigint, 'b': 0::bigint, 'k': 0::bigint, 'degree': (select list_transform(range(max(doc_id)::bigint + 1), lambda i: 0) from documents), 'kept': []::bigint[]}) as f from scan)
select a, b, sim, days, shared, weight, reason from placed where k in (select unnest(f.kept) from walked)"""

_OPEN = "list_filter(flatten(list_transform(m, lambda i: beside[i])), lambda i: not list_contains(m, i) and not list_contains(s.used, i))"
_BEST = "list_min(list_transform(map_entries(list_histogram(c)), lambda h: {'less': -(h.value::int), 'node': h.key}))"
_STEP = f"""list_transform([{_OPEN}], lambda c: case when len(c) = 0 then m else list_transform([{_BEST}],
    lambda best: case when -best.less >= greatest(1, ceil(0.34::double * len(m))) then list_append(m, best.node) else m end)[1] end)[1]"""
_GROWN = f"list_reduce(list_transform(range(10), lambda i: []::int[]), lambda m, none: {_STEP}, [x.x, x.y])"

#: Over r (a, b, sim, rec): clusters (cluster, members, n_edges, density, strength, min_recurrence).
CLUSTERS = f"""
strong as (select a, b, least(1.5, sim * (1 + 0.5 * least(1, rec / 5.0::double))) as score, rec from r where least(1.5, sim * (1 + 0.5 * least(1, rec / 5.0::double))) >= 0.30),
node as (select name, (row_number() over (order by name))::int as i from (select a as name from strong union select b from strong)),
edge as (select x.i as x, y.i as y, strong.* from strong join node x on x.name = a join node y on y.name = b),
beside as (select list(l order by i) as beside from (select i, list(o order by o) as l from (select x as i, y as o from edge union all select y, x from edge) group by i)),
seeds as (select list({{'x': x, 'y': y, 'k': a || '|' || b, 'used': []::int[], 'done': []::struct(k varchar, m int[])[]}} order by score desc, a || '|' || b) as l from edge),
grown as (select list_reduce(l, lambda s, x: case when list_contains(s.used, x.x) and list_contains(s.used, x.y) then s else
    list_transform([{_GROWN}], lambda g: {{'x': 0, 'y': 0, 'k': '', 'used': list_concat(s.used, g), 'done': list_append(s.done, {{'k': x.k, 'm': g}})}})[1] end,
    {{'x': 0, 'y': 0, 'k': '', 'used': []::int[], 'done': []::struct(k varchar, m int[])[]}}) as f from seeds, beside),
names as (select list(name order by i) as names from node),
found as (select c.k, c.m, list_sort(list_transform(c.m, lambda i: names[i])) as members from (select unnest(f.done) as c from grown), names),
clusters as (select k as cluster, any_value(members) as members, count(*) as n_edges,
    count(*) / (len(any_value(m)) * (len(any_value(m)) - 1) / 2)::double as density, sum(score) as strength, min(rec)::bigint as min_recurrence
  from found join edge on list_contains(m, x) and list_contains(m, y) group by k)"""

#: Of clusters: insights after two runs, of which the second meets each one again.
INSIGHTS = f"""
insights as (select cluster as id, members, round(strength, 4) as strength, len(members)::bigint as size, 2::bigint as runs, {NOW}::bigint as first_ms, ({NOW} + 1)::bigint as last_ms, 'promoted' as status
  from clusters where len(members) between 3 and 12 and density >= 0.34 and min_recurrence >= 2 and strength >= 0.90)"""

CONTRADICTIONS = f"""
m as (select floor(ord / 12)::bigint::varchar as cluster, ord, case when ord % 2 = 0 then 'We prefer ' else 'Never use ' end || text as text from chunk),
w as (select cluster, ord, regexp_matches(text, {quoted(T.DENIES, True)}) as neg, regexp_matches(text, {quoted(T.FAVOURS, True)}) as fav, {WORDS.format("text")} as words from m),
d as (select cluster, ord, neg, fav, list_filter(words, lambda v, i: list_position(words, v) = i) as words from w),
p as (select x.cluster, x.ord as a, y.ord as b, list_filter(x.words, lambda v: list_contains(y.words, v)) as shared
  from d x join d y on x.cluster = y.cluster and x.ord < y.ord and (x.neg and y.fav or x.fav and y.neg))
select cluster, a, b, array_to_string(list_sort(shared[1:5]), ',') as shared from p where len(shared) >= 2"""

_NEAR = "greatest(0, coalesce(list_max(list_transform(s, lambda t: list_cosine_similarity(t.v, c.v))), 0))"
#: Diverse cross-links of every hundredth chunk: the next of 8 is the best by similarity less half the most likeness to those taken.
CONNECTED = f"""
near as (select q.ord as seed, c.ord as id, c.vector as v, round(list_cosine_similarity(q.vector, c.vector), 6) as rel from chunk q join chunk c on q.ord % 100 = 0 and c.rel <> q.rel),
pool as (select seed, list({{'id': id, 'rel': rel, 'v': v}} order by rel desc, id) as pool from near where rel >= 0.2 and rel < 0.85 group by seed),
picked as (select seed, list_reduce(list_transform(range(8), lambda i: []::struct(mmr double, rel double, less bigint, red double, v double[])[]),
    lambda s, none: case when len(s) >= len(pool) then s else list_append(s, list_sort(list_transform(
      list_filter(pool, lambda c: not list_contains(list_transform(s, lambda t: -t.less), c.id)),
      lambda c: {{'mmr': round(c.rel - 0.5 * {_NEAR}, 12), 'rel': c.rel, 'less': -c.id, 'red': {_NEAR}, 'v': c.v}}), 'desc')[1]) end,
    []::struct(mmr double, rel double, less bigint, red double, v double[])[]) as f from pool)
select seed, -f[i].less as id, f[i].rel as rel, round(f[i].red, 6) as redundancy, round(f[i].mmr, 6) as mmr, (i - 1)::bigint as pos from picked, unnest(range(1, len(f) + 1)) as u(i)"""

# --- the index over time, the learn job, reports -----------------------------------------------------------------

#: Chunks of all documents' notes after a refresh; notes with a label were changed, notes of the benchmark are gone.
_REFRESHED = f"""{CHUNKS.replace("with lines", "lines").rsplit("select doc_id, n::int", 1)[0].strip().rstrip(",")},
chunk as (select doc_id, c[n + 1].start as start_line, c[n + 1].text as text from whole, unnest(range(len(c))) as u(n)),
marked as (select distinct doc_id from labels where quality is not null),
refreshed as (select source || '/' || doc_id as rel, start_line::int as start_line, chunk.text, doc_id not in (select doc_id from marked) as reused, lang from chunk join documents using (doc_id))"""
INDEX = f"""with {_REFRESHED}
select row_number() over (order by rel, start_line) - 1 as ord, rel, start_line, lang as type, md5(text) as text_md5, reused, case when reused then -1.0 else length(text) end::double as v from refreshed"""
INDEX_COUNTS = f"""with {_REFRESHED}
select 'files' as what, count(distinct rel) as n from refreshed union all select 'reused', count(*) from refreshed where reused union all select 'embedded', count(*) from refreshed where not reused
union all select 'removed', count(*) from benchmark"""

#: Over chunk: links of similarity 0.2 or more, capped, as the first round of a graph whose clusters have a theme.
LEARNED = f"""
note as (select rel, text, vector, row_number() over (order by rel) as i from chunk where vector is not null),
l as (select x.i as a, y.i as b, round(list_cosine_similarity(x.vector, y.vector), 6) as sim from note x join note y on x.i < y.i),
w as (select a, b, sim, null as days, 0 as shared, 0.15 + 0.85 * least(1, greatest(0, (sim - 0.2::double) / (0.85::double - 0.2::double))) as s, 0 as t, 0 as e from l where sim >= 0.2 and sim < 0.85),
{CAPPED.rsplit("select a, b, sim", 1)[0].strip().rstrip(",").replace("edge as", "link as", 1).replace("from edge)", "from link)")},
kept as (select x.rel as a, y.rel as b, weight as sim, 1 as rec from placed join note x on x.i = placed.a join note y on y.i = placed.b where k in (select unnest(f.kept) from walked)),
r as (select * from kept),{CLUSTERS},
good as (select * from clusters where len(members) between 2 and 12 and density >= 0.34 and strength >= 0.3),
word as (select cluster, unnest(list_distinct({WORDS.format("text")})) as word from (select cluster, unnest(members) as rel from good) join note using (rel)),
counted as (select cluster, word, count(*) as n from word group by 1, 2 having count(*) >= 2),
ranked as (select *, row_number() over (partition by cluster order by n desc, word) as r from counted),
theme as (select cluster, string_agg(word, ' · ' order by r) as theme from ranked where r <= 3 group by 1)
select cluster, array_to_string(members, ',') as members, n_edges, round(density, 3) as density, round(strength, 4) as strength, theme from good left join theme using (cluster)"""

TO_PHRASE = """
best as (select * from insights order by runs desc, strength desc, id limit 12)
select id, size, runs, (i - 1)::int as pos, members[i] as member, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120) as snippet
  from best, unnest(range(1, least(8, len(members)) + 1)) as u(i) join documents on doc_id::varchar = members[i]"""

HEADS = """
with f as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[1:3] as l from documents)
select doc_id::varchar as name, (i - 1)::int as pos, regexp_replace(l[i], '^#* *', '') as line from f, unnest(range(1, len(l) + 1)) as u(i)"""

DISTILLED = f"""with {redaction()},
d as (select doc_id, source, 'Note ' || doc_id as title, t.text as content, lang, left(sha256('Note ' || doc_id || chr(10) || source || chr(10) || t.text || chr(10)), 8) as h from documents join t{len(T.SECRETS)} t using (doc_id))
select 'note-' || doc_id || '-' || h || '.md' as path, md5('---' || chr(10) || 'type: distilled' || chr(10) || 'status: active' || chr(10) || 'date: 2024-06-01' || chr(10) || 'source: ' || source || chr(10)
  || 'provenance: sha256-' || h || chr(10) || 'tags: [' || lang || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || content || chr(10)) as value_md5 from d"""

MESSAGES = """
select conv_id, turn, case role when 'system' then 'note' else role end as role, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text_md5,
  case role when 'user' then '2024-01-01' when 'assistant' then '2024-01-02' else '' end as ts from conversations where trim(text) <> ''"""

DATASETS = """
select 'turns' as kind, conv_id || '/D1:' || turn as id, md5(role || ': ' || text) as text_md5 from conversations where text <> ''
union all select 'sessions', 'q' || conv_id || '/s' || conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) from conversations group by conv_id
union all select 'asked', 'q' || conv_id || '/s' || conv_id, md5('Who said ' || conv_id || '?') from conversations group by conv_id"""

NOTES = f"""with {CHUNKS.replace("with lines", "lines").rsplit("select doc_id, n::int", 1)[0].strip().rstrip(",")},
chunk as (select 'memory/' || source || '/' || doc_id || '.md' as rel, c[n + 1].start as start_line, c[n + 1].text as text from whole join documents using (doc_id), unnest(range(len(c))) as u(n))
select row_number() over (order by rel, start_line) - 1 as ord, rel, start_line::int as start_line, 'note' as type, 'active' as status, md5(text) as text_md5 from chunk"""

TAILS = f"""with {UNITS}
select id, any_value(src) as src, any_value(month) as month from (select *, 'thread' as src, '2024-01' as month from units) group by id"""
