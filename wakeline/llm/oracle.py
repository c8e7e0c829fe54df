"""DuckDB SQL for the queries that SQL can express on whole tables."""

from wakeline.llm.license_scan import mandatory, parsed
from wakeline.llm.license_templates import BASE, NOTICES, TEXTS

ORACLE = {}

ORACLE["op4_exact_dedup"] = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents
)
select doc_id, min(doc_id) over (partition by content) as keep_id, count(*) over (partition by content) as group_size,
  row_number() over (partition by content order by doc_id nulls last) = 1 as kept, sha256(content) as text_sha256
from n
"""

ORACLE["op3_url_lists"] = r"""
with p as (
  select page_id, url, 1704067200 + (page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400 as fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') as host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages
), patterns as (
  select distinct kind, pattern from (
    select 'host' as kind, host as pattern from p
    union all select 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) from p
    union all select 'prefix', host || '/' || regexp_extract(path, '^/([^/]+)', 1) from p)
  where pattern <> '' and pattern not like '%/'
), numbered as (
  select *, ('0x' || substr(md5(kind || '|' || pattern), 1, 6))::bigint as x from patterns
), entries as (
  select kind, pattern, x % 200 as day, true as active from numbered where x % 3 = 0
  union all select kind, pattern, x % 200 + 30 + x % 50, x % 2 <> 0 from numbered where x % 3 = 0
  union all select kind, pattern, x % 200 + 120, x % 5 = 0 from numbered where x % 3 = 0
), states as (
  select kind, pattern, 1704067200 + day * 86400 as starts, bool_or(active) as active from entries group by all
), spans as (
  select *, coalesce(lead(starts) over (partition by kind, pattern order by starts), 1e18::bigint) as ends,
    lag(active) over (partition by kind, pattern order by starts) as before_ from states
), grown as (
  select kind, pattern, starts, ends, active, sum((active and not coalesce(before_, false))::int) over (partition by kind, pattern order by starts) as run from spans
), intervals as (
  select kind, pattern, min(starts) as starts, max(ends) as ends from grown where active group by kind, pattern, run
), wanted as (
  select page_id, fetched, 'host' as kind, host as pattern from p where host <> ''
  union all
  select page_id, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p where host <> '')
  union all
  select page_id, fetched, 'prefix', host || '/' || array_to_string(steps[1:i], '/') from (
    select *, unnest(range(0, len(steps) + 1)) as i from (select *, list_filter(string_split(path, '/'), lambda s: s <> '') as steps from p where host <> ''))
), met as (
  select page_id, sum((i.kind <> 'prefix')::int) as n_block, sum((i.kind = 'prefix')::int) as n_allow, max(case when i.kind <> 'prefix' then starts end) as since
  from wanted w join intervals i on w.kind = i.kind and w.pattern = i.pattern and starts <= fetched and fetched < ends
  group by page_id
)
select page_id, host, fetched, coalesce(n_block, 0)::bigint as n_block, coalesce(n_allow, 0)::bigint as n_allow, since,
  case when n_block > 0 and n_allow = 0 then 'blocked' else 'allowed' end as verdict
from p left join met using (page_id)
"""

ORACLE["op5_substring_dedup"] = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), t as (
  select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13
), h as (
  select doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) as run from t
), m as (
  select doc_id, i, min(doc_id) over (partition by run) as least from h
), c as (
  select distinct doc_id, unnest(range(i, i + 13)) as i from m where least < doc_id
), r as (
  select doc_id, list(i) as gone, count(*) as n from c group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then words else list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end, ' '), '')) as kept_sha256
from w left join r using (doc_id)
"""

ORACLE["op10_warc"] = r"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, row_number() over same as place, first_value(page_id) over same as first_id from p
  window same as (partition by payload_digest order by page_id nulls last)
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and place > 1 then first_id end as refers_to
from f
"""

ORACLE["op8_decontamination"] = r"""
with lower_case as (
  select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents, lower_case
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark, lower_case
), patterns as (
  select distinct item_id, size, array_to_string(words[i:i + size - 1], ' ') as run from (
    select item_id, words, least(len(words), 13) as size, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from b where len(words) > 0)
), sizes as (
  select distinct size from patterns
), runs as (
  select doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') as run from (
    select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes where len(words) >= size)
), hits as (
  select doc_id, i, r.size, item_id from runs r join patterns p on r.size = p.size and r.run = p.run
), covered as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as i from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

ORACLE["op9_near_dedup"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle from (
    select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
  select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * both_ >= 85 * (x.n + y.n - both_)
), e as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select a, b from e union select r.doc_id, e.b from reach r join e on r.other = e.a
), least_ as (
  select doc_id, min(other) as other from reach group by doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id,
  doc_id = least(doc_id, coalesce(other, doc_id)) as kept
from documents left join n using (doc_id) left join least_ using (doc_id)
"""

ORACLE["op13_filter_audit"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), m as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
      + 16 * (first_id is not null and (d.doc_id is null or d.doc_id > first_id))::int as fails
  from d left join m on d.doc_id = m.doc_id
), g as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), l as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b
), o as (
  select p.c || q.c || r.c || s.c || t.c as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits
  from l p join l q on p.b <> q.b join l r on r.b not in (p.b, q.b) join l s on s.b not in (p.b, q.b, r.b) join l t on t.b not in (p.b, q.b, r.b, s.b)
), s as (
  select filter_order, step, bits[step] as bit, list_sum(bits[1:step]) - bits[step] as prefix from (select *, unnest([1, 2, 3, 4, 5]) as step from o)
), c as (
  select part, filter_order, step, bit,
    sum(case when fails & (prefix | bit) = 0 then n else 0 end) as kept, sum(case when fails & prefix = 0 and fails & bit > 0 then n else 0 end) as removed,
    sum(case when fails & prefix > 0 and fails & bit > 0 then n else 0 end) as redundant, sum(case when fails = bit then n else 0 end) as unique_fails,
    sum(case when fails & prefix = 0 and fails & bit > 0 then good else 0 end) as good_lost,
    sum(case when fails & prefix = 0 and fails & bit > 0 then toxic else 0 end) as toxic_lost
  from g, (select filter_order, step, bit::int as bit, prefix::int as prefix from s) group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from c
"""


def template_pattern(parts: list) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    out = ""
    for part in parts:
        if isinstance(part, bytes):
            out += part.decode() + " "
        else:
            out += f"(?:{template_pattern(part)})?" if isinstance(part, list) else f"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
    return out


def license_sql() -> str:
    templates = [(label, parsed(markup)) for label, markup in (*BASE, *NOTICES, *TEXTS)]
    values = ", ".join(f"('{label}', {mandatory(parts)}, ' {template_pattern(parts)}')" for label, parts in templates)
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for label, phrase in BASE)
    return rf"""
with d as (
  select row_number() over () as n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), b(label, phrase) as (
  values {phrases}
), t(label, mandatory, pattern) as (
  values {values}
), p as (
  select n, label, unnest(list_filter(range(0, len(words) - len(phrase) + 1), lambda i: words[i + 1:i + len(phrase)] = phrase)) as place from d, b
), places as (
  select n, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by n
), found as (
  select n, string_agg(distinct label, ',' order by label) as labels, max(mandatory) as most
  from (select n, ' ' || array_to_string(words, ' ') || ' ' as joined from d) j, t where regexp_matches(joined, pattern) group by n
)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(most::double / (most + 1), 0) as score
from d left join places using (n) left join found using (n)
"""


ORACLE["op12_license_scan"] = license_sql()
