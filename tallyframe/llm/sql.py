"""DuckDB SQL for those numbered operators that SQL can express over whole tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

OP1 = f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
shingles as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as same from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * same >= 75 * (p.n + q.n - same)),
both_ as (select x, y from links union select y, x from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join both_ b on r.y = b.x)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)"""

_HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "case when instr({0}, '://') > 0 then substr({0}, instr({0}, '://') + 3) else '' end"
_NODE = "(" + _HOST.format("{0}") + r" || case when regexp_extract({0}, '^[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract({0}, '^[^/?#]*([^#]*)', 1) end)"

# Pages are nodes under their url without scheme and fragment; canonical links and refresh redirects are edges.
OP5 = rf"""with recursive u as (select page_id, url, {_REST.format("url")} as rest, html from pages),
tags as (select url, rest, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) as tag from u where instr(url, '://') > 0),
links as (select url, rest, trim(replace(case when regexp_matches(tag, '(?i)^<link') then regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) else regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) end, '&amp;', '&'), ' ') as link
  from tags where regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical\b') or regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
targets as (select rest, split_part(url, '://', 1) as scheme, {_HOST.format("rest")} as host, regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^(.*/)?[^/]*$', 1) as folder, link from links where link <> ''),
full_links as (select rest, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then scheme || ':' || link when starts_with(link, '/') then scheme || '://' || host || link
  when starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null else scheme || '://' || host || case when folder = '' then '/' else folder end || link end as target from targets),
joined as (select {_NODE.format("rest")} as a, {_NODE.format("(" + _REST.format("target") + ")")} as b from full_links where target is not null),
both_ as (select a, b from joined where b <> '/' and a <> b union select b, a from joined where b <> '/' and a <> b),
reach as (select distinct a as x, a as y from both_ union select r.x, e.b from reach r join both_ e on r.y = e.a),
rules(h, r, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
addresses as (select distinct rest from (select rest from u union all select a from both_)),
best as (select rest, h || r as rule, action from (select rest, {_HOST.format("rest")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from addresses) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, r) qualify row_number() over (partition by rest order by length(h || r) desc) = 1),
spread as (select x, bool_or(action = 'block') as blocked, bool_or(action = 'allow') as allowed from reach left join best on best.rest = y group by x)
select page_id, {_HOST.format("u.rest")} as host, regexp_extract(u.rest, '^[^/?#]*([^?#]*)', 1) as path, rule, coalesce(action, case when blocked and not coalesce(allowed, false) then 'block' end, 'allow') as verdict
from u left join best on best.rest = u.rest left join spread on x = {_NODE.format("u.rest")}"""

OP6 = """with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
good as (select * from v where list_sum(list_transform(e, lambda x: abs(x))) > 0),
both_ as (select a.vec_id as x, b.vec_id as y from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, b.y from reach r join both_ b on r.y = b.x)
select m.vec_id, coalesce(n, 0) as n_links, c.component_id, m.vec_id = c.component_id as kept
from embeddings m left join (select x as vec_id, count(*) as n from both_ group by x) using (vec_id) join (select x as vec_id, min(y) as component_id from reach group by x) c using (vec_id)"""

OP10 = """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as best from pages),
d as (select *, list_transform(range(0, 32), lambda i: ((strpos('0123456789abcdef', h[i * 5 // 4 + 1]) - 1) * 16 + case when i * 5 // 4 + 2 <= 40 then strpos('0123456789abcdef', h[i * 5 // 4 + 2]) - 1 else 0 end) // cast(pow(2, 3 - i * 5 % 4) as int) % 32) as five from p)
select page_id, payload_bytes, array_to_string(list_transform(five, lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[k + 1]), '') as payload_digest,
case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to from d"""


_ESCAPE = r"regexp_replace(regexp_replace({0}, '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(<)(\\*(?:/?s|\|(?:text|image|audio|document|other)\|)>)', '\1\\\2', 'g')"

# Marks count 3 + 4 code points around a learned turn, 6 + 1 + 7 around another with its role.
OP11 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
  sum(length({_ESCAPE.format("text")}) + case when role = 'assistant' then 7 else 14 + length(replace(replace({_ESCAPE.format("role")}, '%', '%25'), chr(10), '%0A')) end) as formatted_chars from t group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op5_url_filter": OP5, "op6_embedding_near_dedup": OP6, "op10_warc_revisits": OP10, "op11_chat_format": OP11}
