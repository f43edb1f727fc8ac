"""SQL for DuckDB, by query; queries that SQL can't express are tested against brute force instead."""

from __future__ import annotations

from . import op1_license, op2_chat, op6_quality, op8_warc, op9_urls, op13_fim

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op2() -> str:
    t = op2_chat.TEMPLATE
    quoted = "replace(coalesce(text, ''), '\\', '\\\\')"
    for c in t.controls:
        quoted = f"replace({quoted}, {_text(c)}, {_text(c[0] + t.escape + c[1:])})"
    marks = " ".join(f"when {_text(r)} then {len(m.opening) + len(m.closing)}" for r, m in t.roles.items())
    legal = ", ".join(_text(f"{a}>{b}") for a, bs in t.order.items() for b in bs)
    loss = ", ".join(_text(r) for r, m in t.roles.items() if m.loss)
    return f"""
with rows_ as (
  select conv_id::bigint as conv_id, turn::bigint as turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns as (
  select conv_id, turn, role, coalesce(text, '') as text, length({quoted}) + case role {marks} end as chars,
    coalesce(lag(role) over (partition by conv_id order by turn), '') || '>' || role as step
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role in ({loss})), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role in ({loss})), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, bool_and(step in ({legal})) as valid
from turns group by conv_id"""


_OP3 = f"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) as w from documents),
places as (select doc_id, unnest(range(1, len(w) - 11)) as s, w from words where len(w) >= 13),
windows as (select doc_id, s, array_to_string(w[s : s + 12], ' ') as k from places),
owners as (select k, min(doc_id) as owner from windows group by k),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as p from windows join owners using (k) where owner < doc_id),
removed as (select doc_id, count(*) as n, list(p) as p from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(case when n is null then array_to_string(w, ' ')
    else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(p, i)), lambda i: w[i]), ' ') end) as kept_sha256
from words left join removed using (doc_id)"""

_OP4 = f"""
with docs as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
bench as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark),
pattern as (
  select distinct item_id, least(13, len(w)) as m, array_to_string(w[s : s + 12], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as s from bench where len(w) > 0)
),
lengths as (select distinct m from pattern),
places as (select doc_id, m, w, unnest(range(1, len(w) - m + 2)) as s from docs, lengths where len(w) >= m),
hits as (select doc_id, s, p.m, item_id from (select doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') as k from places) a join pattern p on a.k = p.k and a.m = p.m),
hit_words as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(s, s + m)) from hits) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(h.n > 0 and 20 * h.n >= len(w), false) as contaminated
from docs left join hit_words h using (doc_id) left join items i using (doc_id)"""

_OP6 = f"""
with docs as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_SPACE}) as w from documents),
raw as (select doc_id, source, text, unnest(string_split(text, chr(10))) as raw from docs),
lines as (select doc_id, source, text, raw, len(regexp_extract_all(raw, {_SPACE})) as n, array_to_string(regexp_extract_all({_LOWER.replace("text", "raw")}, {_SPACE}), ' ') as line from raw where len(regexp_extract_all(raw, {_SPACE})) > 0),
dup as (select doc_id, count(*) - count(distinct raw) as n from lines group by doc_id),
windows as (select doc_id, s, array_to_string(w[s : s + 2], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as s from docs where len(w) >= 3)),
again as (select doc_id, k from windows group by doc_id, k having count(*) > 1),
rep as (select doc_id, count(*) as n from (select distinct doc_id, unnest([s, s + 1, s + 2]) from windows join again using (doc_id, k)) group by doc_id),
sizes as (select source, count(distinct (doc_id, text)) as n from docs group by source),
hot as (
  select l.source, line, min(doc_id) as first_doc from lines l join sizes using (source)
  group by l.source, line, sizes.n having count(distinct (doc_id, text)) > {op6_quality.MIN_DOCS} and count(distinct (doc_id, text)) > {op6_quality.MAX_SHARE!r}::double * sizes.n
),
gone as (select doc_id, sum(n) as n from lines join hot using (source, line) where doc_id <> first_doc group by doc_id),
base as (
  select docs.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as removed_words
  from docs left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {op6_quality.MIN_WORDS} or 100 * n_repeat_words > {op6_quality.MAX_REPEAT} * n_words as base_failed, removed_words,
  not (n_words < {op6_quality.MIN_WORDS} or 100 * n_repeat_words > {op6_quality.MAX_REPEAT} * n_words) and n_words - removed_words >= {op6_quality.MIN_LEFT} * n_words as kept
from base"""

_CANONICAL = f"""
select page_id, coalesce(html, '') as html, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' as etag,
  case when scheme = '' or host = '' then null else scheme || '://' || host || case when path = '' then '/' else path end
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as url
from (select *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '{op8_warc.TRACKING}'))) as kept
  from (select page_id, html, scheme, case when scheme = 'https' then regexp_replace(h, ':443$', '') else regexp_replace(h, ':80$', '') end as host,
      regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path, regexp_extract(rest, '\\?(.*)$', 1) as query
    from (select page_id, html, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, rest, lower(regexp_extract(rest, '^([^/?]*)', 1)) as h
      from (select *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from (select page_id, html, regexp_replace(trim(url), '#.*$', '') as u from pages)))))"""

_OP8 = f"""
with p as ({_CANONICAL}),
asked as (select r.page_id, r.url, case when r.page_id % 7 = 3 then '"old"' else r.etag end as etag,
  (select max(s.page_id) from p s where s.url = r.url and 10 * s.page_id < 10 * (r.page_id - 3 + 8 * (r.page_id % 4)) + 5) as of_page from p r),
found as (select a.*, s.etag as stored, s.html from asked a left join p s on a.of_page = s.page_id)
select 2 * page_id + 1 as record_id, url, 2 * of_page as response_id,
  case when of_page is null then 'no_response' when etag = stored then 'resolved' else 'validator_mismatch' end as outcome,
  case when etag = stored then 'content-type: text/html' || chr(10) || 'date: r' || page_id || chr(10) || 'etag: ' || etag end as headers,
  case when etag = stored then sha256(html) end as payload_sha256, case when etag = stored then length(html)::bigint end as payload_chars
from found"""


def _op9() -> str:
    rules = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in op9_urls.RULES)
    hosts = ", ".join(f"({_text(h)})" for h in op9_urls.LISTED_HOSTS)
    return f"""
with rules(key, verdict) as (values {rules}), listed(host) as (values {hosts}),
split as (
  select page_id, case when rest is null then '' else translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
    case when rest is null then '' else regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) end as path
  from (select page_id, case when url like '%://%' then substr(url, position('://' in url) + 3) end as rest from pages)
),
fits as (
  select page_id, first(key order by length(key) desc, key) as rule, first(verdict order by length(key) desc, key) as verdict from split, rules
  where (host = split_part(key, '/', 1) or ends_with(host, '.' || split_part(key, '/', 1))) and starts_with(path, substr(key, position('/' in key))) group by page_id
)
select s.page_id, s.host, path, rule, coalesce(verdict, case when exists (select 1 from listed l where s.host = l.host or ends_with(s.host, '.' || l.host)) then 'block' else 'allow' end) as verdict
from split s left join fits using (page_id)"""


def _op1() -> str:
    """A row for each template: its words, the key phrase that each of them follows, and the key phrases with their places."""
    words = lambda x: "[" + ", ".join(_text(w.decode()) for w in x) + "]"
    rows = []
    for t in op1_license.TEMPLATES:
        keys = t.key_places()
        after = [max(1, sum(at <= i for at, _ in keys)) for i in range(len(t.words()))]
        rows.append(f"({_text(t.label)}, {str(t.base).lower()}, {words(t.words())}, {after}, {[at for at, _ in keys]}, [{', '.join(words(k) for _, k in keys)}])")
    return f"""
with docs as materialized (select doc_id, row_number() over () as row_, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
template(label, base, words, after_, offsets, keys) as (values {', '.join(rows)}),
phrase as (select distinct unnest(keys) as key from template),
places as materialized (
  select row_, key, unnest(list_filter(range(1, len(w) - len(key) + 2), lambda p: w[p] = key[1] and w[p : p + len(key) - 1] = key)) as p
  from docs, phrase where list_has_all(w, key)
),
starts as (select row_, label, base, words, after_, offsets, keys, p - offsets[1] as start from places join template on key = keys[1]),
parts as (select label, unnest(keys) as key, unnest(offsets) as offset_, unnest(range(1, len(keys) + 1)) as j from template),
near as (
  select s.row_, s.label, s.start, parts.j, min_by(p - s.start - offset_, 2 * abs(p - s.start - offset_) + (p > s.start + offset_)::int) as drift
  from starts s join parts using (label) join places on places.row_ = s.row_ and places.key = parts.key
  where case when parts.j = 1 then p = s.start + offset_ else abs(p - s.start - offset_) <= {op1_license.DRIFT} end group by all
),
drifted as (select row_, label, start, list(drift order by j) as drifts from near group by all),
scored as (
  select s.row_, s.label, base, start, case when base then 0.5::double else 0.5::double + 0.5::double * (len(list_filter(range(1, len(words) + 1),
    lambda i: start + drifts[after_[i]] + i - 1 between 1 and len(w) and w[start + drifts[after_[i]] + i - 1] = words[i]))::double / len(words)) end as score
  from starts s join drifted using (row_, label, start) join docs using (row_) where len(drifts) = len(keys)
),
found as (
  select row_, count(*) filter (base) as n_base, min(start - 1) filter (base) as first_word, max(start - 1) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score
  from scored group by row_
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from docs left join found using (row_)"""


_OP12 = """
with own as (
  select conv_id as c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
  from conversations where conv_id is not null group by conv_id
),
hashed as (
  select c, turns, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 4 as h
  from own
),
rebuilt as (select a.c, list_concat(coalesce(b.turns[1 : a.h], []), a.turns[a.h + 1 :]) as turns from hashed a left join own b on b.c = a.c - a.c % 20),
prefix as (select c, d, turns[1 : d] as p, len(turns) = d as ends from (select c, turns, unnest(range(len(turns) + 1)) as d from rebuilt)),
node as (select p, d, min(c) as id, count(*) as n, string_agg(c::varchar, ',' order by c) filter (ends) as ends, case when d > 0 then len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) else 0 end as words from prefix group by p, d),
below as (select a.p, a.d, count(*) filter (b.d = a.d + 1) as n_children, sum((b.n - 1) * b.words) as saved from node a join node b on b.d >= a.d and b.p[1 : a.d] = a.p group by all),
leaf as (select p, d from below where n_children = 0),
leaves as (select a.p, a.d, count(*) as n_leaves from node a join leaf b on b.d >= a.d and b.p[1 : a.d] = a.p group by all)
select a.id as conv_id, a.d as depth, u.id as parent_conv_id, a.n as n_convs, n_children, n_leaves, saved::bigint as saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from node a join below using (p, d) join leaves using (p, d) left join node u on u.d = a.d - 1 and u.p = a.p[1 : a.d - 1]"""

_OP13 = f"""
with seeded as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents
),
cut as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when text = '' or contains(text, '{op13_fim.PREFIX}') or contains(text, '{op13_fim.SUFFIX}') or contains(text, '{op13_fim.MIDDLE}') or h3 % 100 >= {op13_fim.RATE} then 'plain' when h4 % 100 < {op13_fim.SPM_RATE} then 'spm' else 'psm' end as form
  from (select *, {', '.join(f"('0x' || substr(s, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))} from seeded)
),
part as (select *, array_to_string(u[1 : a], '') as prefix, array_to_string(u[a + 1 : b], '') as middle, array_to_string(u[b + 1 :], '') as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{op13_fim.PREFIX}' || prefix || '{op13_fim.SUFFIX}' || suffix || '{op13_fim.MIDDLE}' || middle
    else '{op13_fim.SUFFIX}' || suffix || '{op13_fim.PREFIX}' || prefix || '{op13_fim.MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from part"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _op1(),
    "op2_chat_formatting": _op2(),
    "op3_substring_dedup": _OP3,
    "op4_benchmark_decontamination": _OP4,
    "op6_quality_rules": _OP6,
    "op8_warc_revisits": _OP8,
    "op9_url_filter": _op9(),
    "op12_prefix_trie": _OP12,
    "op13_fill_in_middle": _OP13,
}
