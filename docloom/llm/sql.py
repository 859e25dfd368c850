"""DuckDB counterparts of the queries that SQL can express, over the same whole tables."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents
), w as (
  select *, regexp_extract_all(t, '{WORD}') as words, [l for l in string_split(t, chr(10)) if regexp_matches(l, '{WORD}')] as lines from d
), win as (
  select r, i, array_to_string(words[i:i + 7], ' ') as g from (select r, words, unnest(generate_series(1, len(words) - 7)) as i from w)
), rep as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1
), cov as (
  select r, sum(least(8, i - coalesce(last, i - 8)))::bigint as n_repeat_words from (select r, i, lag(i) over (partition by r order by i) as last from rep) group by r
), m as (
  select w.r, doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join cov using (r)
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    n_symbols / greatest(n_words, 1)::double as symbol_share, n_dup_lines / greatest(n_lines, 1)::double as dup_line_share,
    n_repeat_words / greatest(n_words, 1)::double as repeat_share, word_chars / greatest(n_words, 1)::double as mean_word
  from m
), v as (
  select r, lang, source, base_failed, measure, x, case measure when 'symbol_share' then 0.9::double when 'mean_word' then 0.75::double else 0.99::double end as high,
    case when x < 0.0001 then -1000000 else ceil(ln(x) / ln(1.01::double))::int end as bucket
  from (select r, lang, source, base_failed, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'mean_word']) as measure, unnest([symbol_share, dup_line_share, repeat_share, mean_word]) as x from b)
), f0 as (
  select 'own' as lvl, lang, source, measure, bucket, high, count(*) as n from v where not base_failed group by all
  union all select 'lang', lang, null, measure, bucket, high, count(*) from v where not base_failed group by all
  union all select 'all', null, null, measure, bucket, high, count(*) from v where not base_failed group by all
), f1 as (
  select *, sum(n) over (partition by lvl, lang, source, measure) as total, sum(n) over (partition by lvl, lang, source, measure order by bucket) as upto from f0
), f2 as (
  select lvl, lang, source, measure, max(total) as n_docs, min(bucket) filter (upto >= ceil(0.25::double * total)) as q1, min(bucket) filter (upto >= ceil(high * total)) as q2
  from f1 group by all
), f3 as (
  select *, case when q1 = -1000000 then 0::double else 2 * pow(1.01::double, q1) / 2.01::double end as a, case when q2 = -1000000 then 0::double else 2 * pow(1.01::double, q2) / 2.01::double end as c from f2
), f4 as (
  select lvl, lang, source, measure, n_docs, case when measure = 'mean_word' then c + 3.0::double * greatest(c - a, 0.05::double) else 1.25::double * c + 0.02::double end as most,
    case when measure = 'mean_word' then a - 3.0::double * greatest(c - a, 0.05::double) end as least
  from f3
), k as (
  select v.r, bool_and(o.n_docs is null or v.x <= case when o.n_docs >= 100 then o.most when l.n_docs >= 100 then l.most else g.most end
    and coalesce(v.x >= case when o.n_docs >= 100 then o.least when l.n_docs >= 100 then l.least else g.least end, true)) as verdict
  from v left join f4 o on o.lvl = 'own' and o.lang is not distinct from v.lang and o.source is not distinct from v.source and o.measure = v.measure
    left join f4 l on l.lvl = 'lang' and l.lang is not distinct from v.lang and l.measure = v.measure
    left join f4 g on g.lvl = 'all' and g.measure = v.measure
  group by v.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and verdict as kept from b join k using (r)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_ALNUM}') as words from documents
), items as (
  select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_ALNUM}') as words from benchmark
), pats as (
  select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as g
  from (select item_id, words, least(10, len(words)) as n, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) as i from items where len(words) > 0)
), sizes as (select distinct n from pats
), win as (
  select r, n, i, array_to_string(words[i:i + n - 1], ' ') as g from (select r, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from d cross join sizes)
), hits as (select r, win.n, i, item_id from win join pats on win.n = pats.n and win.g = pats.g
), marked as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from hits) group by r
), named as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from hits where item_id is not null) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join marked using (r) left join named using (r)
"""

OP6 = rf"""
with z as (
  select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u,
    ceil(sqrt(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::double))::bigint * 1000 as w
  from documents
), s0 as (select source, count(*) as n_docs, sum(size)::bigint as source_size from z group by source
), s1 as (select *, row_number() over (order by source is null, source) as rnk from s0
), s2 as (select *, [5, 2, 1][((rnk - 1) % 3 + 1)::int] as weight from s1
), s3 as (
  select *, sum(source_size) over () as total, coalesce(sum(3 * source_size) over (order by source_size * 3 / weight::double, rnk rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(weight) over (order by source_size * 3 / weight::double, rnk rows between current row and unbounded following) as rest, row_number() over (order by source_size * 3 / weight::double, rnk) as place
  from s2
), s4 as (select *, (total - filled)::double / rest::double as level from s3
), s5 as (select *, min(case when weight * level < 3 * source_size then place end) over () as first_place from s4
), s6 as (select *, min(case when place = first_place then level end) over () as first_level from s5
), s as (select source, source_size, case when place >= first_place then weight * first_level else (3 * source_size)::double end as target from s6
), l0 as (select source, w, sum(size) as words from z where w > 0 group by source, w
), l1 as (
  select l0.*, target, coalesce(sum(3 * words) over (partition by source order by w desc rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(w * words) over (partition by source order by w desc rows between current row and unbounded following) as rest
  from l0 join s using (source) where source is not null
  union all
  select l0.*, target, coalesce(sum(3 * words) over (order by w desc rows between unbounded preceding and 1 preceding), 0), sum(w * words) over (order by w desc rows between current row and unbounded following)
  from l0 join s on s.source is null where l0.source is null
), l as (select source, max(w) as w, arg_max((target - filled)::double / rest::double, w) as level from l1 where w * ((target - filled)::double / rest::double) < 3 group by source
), e as (
  select z.*, source_size, s.target, case when z.w = 0 then 0::double when z.w <= l.w then z.w * l.level else 3::double end as e
  from z join s on z.source is not distinct from s.source left join l on z.source is not distinct from l.source
), p as (select *, floor(e) as whole, e - floor(e) as p from e
), q as (select *, case when whole < 3 and p > 0 then u / (1 - u) / (p / (1 - p)) end as q from p
), c as (
  select *, target - sum(whole * size) over (partition by source) as remaining,
    sum(case when q is not null then size else 0 end) over (partition by source order by q nulls last, size, u rows between unbounded preceding and current row) as upto
  from q
)
select doc_id, size, source_size, target, ((whole + case when q is not null and 2 * upto - size <= 2 * remaining then 1 else 0 end) * size)::bigint as taken from c
"""

OP8 = rf"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, i, lines[i] as line, {LOWER.format(r"regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} as key
  from (select r, lines, unnest(generate_series(1, len(lines))) as i from d)
), often as (select key from l where key <> '' group by key having count(distinct r) >= 10
), kept as (select r, string_agg(line, chr(10) order by i) as text, count(*) as n from l where key not in (select key from often) group by r)
select doc_id, len(lines)::bigint as n_lines, (len(lines) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (r)
"""

SQL = {"op3_quality_rules": OP3, "op4_decontaminate": OP4, "op6_mixing": OP6, "op8_line_dedup": OP8}
