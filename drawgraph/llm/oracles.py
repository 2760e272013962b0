"""DuckDB SQL for the queries that SQL can express; written from their definitions, not from the Spark code."""

import re

from .license_rules import BASE, build

MIXING = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as ord
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from sized group by source
), filled as (
  select *, row_number() over (order by source_size * 1.0 / weight, weight, source) as k, sum(source_size) over () as total from sources
), levels as (
  select *, coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as held,
         sum(weight) over (order by k rows between current row and unbounded following) as share
  from filled
), capped as (
  select *, source_size * 4 * share < (3 * total - 4 * held) * weight as is_full from levels
), rest as (
  select max(3 * total) - 4 * coalesce(sum(source_size) filter (is_full), 0) as budget_left, sum(weight) filter (not is_full) as share from capped
), goals as (
  select source, source_size, case when is_full then cast(source_size * 2 as double)
         else cast(budget_left as double) * weight / cast(2 * rest.share as double) end as target
  from capped cross join rest
), placed as (
  select s.doc_id, s.size, s.ord, g.source_size, g.target,
         cast(sum(s.size) over (partition by s.source order by s.ord, s.doc_id rows unbounded preceding) as bigint) as words
  from sized s join goals g on s.source is not distinct from g.source
), copies as (
  select doc_id, size, ord, 0 as i, cast(words as double) / target as v from placed where size > 0
  union all
  select doc_id, size, ord, 1, cast(words + source_size as double) / target from placed where size > 0
), ranked as (
  select *, sum(size) over (order by v, ord, doc_id, i rows unbounded preceding) as used from copies
), chosen as (
  select doc_id, sum(size) as taken from ranked where used * 2 <= (select 3 * sum(size) from sized) group by doc_id
)
select p.doc_id, p.size, p.source_size, p.target, cast(coalesce(c.taken, 0) as bigint) as taken
from placed p left join chosen c on p.doc_id = c.doc_id
"""

QUALITY_RULES = r"""
with base as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base where len(w) >= 3)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), repeated as (
  select doc_id, count(distinct i + k) as n from twice cross join (values (0), (1), (2)) as o(k) group by doc_id
), counts as (
  select b.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
         cast(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from base b left join repeated r on b.doc_id = r.doc_id
), long as (
  select doc_id, lang, source, n_words, unnest([
    {'m': 'symbol_rate', 'x': n_symbols * 10000 // greatest(word_chars, 1), 'least': 100, 'both': false},
    {'m': 'dup_line_rate', 'x': n_dup_lines * 10000 // greatest(n_lines, 1), 'least': 500, 'both': false},
    {'m': 'repeat_rate', 'x': n_repeat_words * 10000 // greatest(n_words, 1), 'least': 300, 'both': false},
    {'m': 'word_length', 'x': word_chars * 1000 // greatest(n_words, 1), 'least': 250, 'both': true}], recursive := true)
  from counts
), binned as (
  select *, (x >> greatest(len(bin(x)) - 7, 0)) << greatest(len(bin(x)) - 7, 0) as b from long where n_words > 0
), levels as (
  select 'own' as lv, lang, source, m, b, least from binned
  union all select 'lang', lang, null, m, b, least from binned
  union all select 'all', null, null, m, b, least from binned
), ranked as (
  select lv, lang, source, m, b, least, row_number() over (partition by lv, lang, source, m order by b) as run, count(*) over (partition by lv, lang, source, m) as n from levels
), quartiles as (
  select lv, lang, source, m, max(n) as docs, min(b) filter (run * 4 >= n) as q1, min(b) filter (run * 4 >= n * 3) as q3, max(least) as least from ranked group by 1, 2, 3, 4
), fences as (
  select *, q1 - 4 * greatest(q3 - q1, least) as low, q3 + 4 * greatest(q3 - q1, least) as high from quartiles
), judged as (
  select l.doc_id, l.m, l.x > (case when o.docs >= 100 then o.high when g.docs >= 100 then g.high else e.high end)
         or (l.both and l.x < (case when o.docs >= 100 then o.low when g.docs >= 100 then g.low else e.low end)) as bad
  from long l
  left join fences o on o.lv = 'own' and o.m = l.m and o.lang is not distinct from l.lang and o.source is not distinct from l.source
  left join fences g on g.lv = 'lang' and g.m = l.m and g.lang is not distinct from l.lang
  left join fences e on e.lv = 'all' and e.m = l.m
), broken as (
  select doc_id, string_agg(m, ',' order by case m when 'symbol_rate' then 0 when 'dup_line_rate' then 1 when 'repeat_rate' then 2 else 3 end) as broke
  from judged where bad group by doc_id
), ruled as (
  select c.*, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, coalesce(b.broke, '') as broke from counts c left join broken b on b.doc_id = c.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and broke = '') as kept, broke from ruled
"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

def _micro(x: str) -> str:
    return f"cast(round(log10(greatest({x}, 1)) * 1e6) as bigint)"


LM_SCORING = rf"""
with w as (
  select doc_id, {_WORDS} as w from documents
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w
), grams as (
  select doc_id, word, i, case when i > 1 then lag(word) over ordered || ' ' || word end as pair, case when i > 2 then lag(word, 2) over ordered || ' ' || lag(word) over ordered || ' ' || word end as triple
  from words window ordered as (partition by doc_id order by i)
), every as (
  select doc_id, word as gram from grams union all select doc_id, pair from grams where i > 1 union all select doc_id, triple from grams where i > 2
), own as (
  select doc_id, gram, count(*) as n from every group by doc_id, gram
), total as (
  select gram, sum(n) as n from own group by gram
), away as (
  select doc_id, gram, total.n - own.n as n from own join total using (gram)
), size as (
  select doc_id, count(*) as n from words group by doc_id
), placed as (
  select g.doc_id, g.i, a1.n as n1, coalesce(a2.n, 0) as n2, coalesce(a3.n, 0) as n3, (select count(*) from words) - s.n as rest
  from grams g join size s using (doc_id) join away a1 on a1.doc_id = g.doc_id and a1.gram = g.word
  left join away a2 on a2.doc_id = g.doc_id and a2.gram = g.pair left join away a3 on a3.doc_id = g.doc_id and a3.gram = g.triple
), context as (
  select *, lag(n1) over ordered as b1, lag(n2) over ordered as b2 from placed window ordered as (partition by doc_id order by i)
), logs as (
  select doc_id, i, n2, n3, {_micro("n1")} - {_micro("rest")} as l1, {_micro("n2")} - {_micro("b1")} as l2, {_micro("n3")} - {_micro("b2")} as l3, cast(round(log10(0.4) * 1e6) as bigint) as step from context
), summed as (
  select doc_id, count(*) as n_words, count(*) filter (n2 > 0) as n_seen, count(*) filter (n3 > 0) as n_full,
         sum(case when n3 > 0 then l3 else case when i > 2 then step else 0 end + case when n2 > 0 then l2 else case when i > 1 then step else 0 end + l1 end end) as log_micro
  from logs group by doc_id
)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_seen, 0) as bigint) as n_seen, cast(coalesce(n_full, 0) as bigint) as n_full, cast(coalesce(log_micro, 0) as bigint) as log_micro,
       case when n_words > 0 then cast(cast(log_micro as bigint) as double) / 1e6 / cast(n_words as double) else 0.0::double end as log_score
from w d left join summed s on s.doc_id = d.doc_id
"""

DECONTAMINATE = rf"""
with d as (
  select doc_id, {_WORDS} as w from documents
), b as (
  select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark
), windows as (
  select item, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), sizes as (
  select distinct size from windows
), grams as (
  select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d cross join sizes)
), hits as (
  select doc_id, i, g.size, item from grams g join (select distinct item, size, g from windows) x on x.size = g.size and x.g = g.g
), covered as (
  select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + size)) as word from (select distinct doc_id, i, size from hits)) group by doc_id
), found as (
  select doc_id, list_sort(list(distinct item)) as items from hits group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered c on c.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _doubled(pattern: str) -> str:
    """The pattern over words that have a space of their own on either side."""
    return " (?:" + re.sub(r" (\?)?", lambda m: "(?:  )?" if m[1] else "  ", pattern) + ") "


def license_scan() -> str:
    rules = ",\n  ".join(f"({i}, {_quoted(label)}, {level}, {_quoted(key)}, {_quoted(_doubled(rx))})" for i, (label, level, key, rx) in enumerate(build()))
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split())})" for p, label in BASE)
    return rf"""
with rules(ord, label, level, key, rx) as (values
  {rules}
), phrases(phrase, label, size) as (values {phrases}
), split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), texts as (
  select doc_id, cast(len(w) as bigint) as n_words, w, ' ' || array_to_string(w, ' ') || ' ' as t, ' ' || array_to_string(w, '  ') || ' ' as t2 from split
), places as (
  select doc_id, w, unnest(range(1, len(w) + 1)) as i from texts where contains(t, ' cc by ') or contains(t, ' general public license ') or contains(t, ' all rights reserved ')
), base as (
  select doc_id, count(*) as n, min(i - 1) as a, max(i - 1) as z, list_sort(list(distinct label)) as labels
  from places join phrases on array_to_string(w[i : i + size - 1], ' ') = phrase group by doc_id
), tried as (
  select doc_id, ord, label, level, regexp_extract_all(t2, rx) as found, string_split_regex(t2, rx) as gaps
  from texts join rules on contains(t, key) and regexp_matches(t2, rx)
), cuts as (
  select doc_id, ord, label, level, found, gaps, unnest(range(1, len(found) + 1)) as k from tried
), spans as (
  select doc_id, ord, label, level, list_sum(list_transform(gaps[:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:k - 1], lambda x: len(x))), 0) as a, len(found[k]) as n from cuts
), kept as (
  select * from spans x where not exists (
    select 1 from spans y where y.doc_id = x.doc_id and y.level <= x.level and y.a <= x.a and y.a + y.n >= x.a + x.n
    and (y.a < x.a or y.n > x.n or y.level < x.level or (y.level = x.level and y.ord < x.ord)))
), method as (
  select doc_id, list(distinct label) as labels, count(*) as n, min(level) as best from kept group by doc_id
)
select t.doc_id, t.n_words, cast(coalesce(b.n, 0) as bigint) as n_base, cast(b.a as bigint) as first_word, cast(b.z as bigint) as last_word,
       coalesce(array_to_string(b.labels, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
       case least(coalesce(m.best, 9), case when b.n > 0 then 3 else 9 end) when 1 then 1.0::double when 2 then 0.8::double when 3 then 0.5::double else 0.0::double end as score,
       cast(coalesce(m.n, 0) as bigint) as n_found
from texts t left join base b on b.doc_id = t.doc_id left join method m on m.doc_id = t.doc_id
"""

#: CRC-32 is computed bitwise from its polynomial: DuckDB has no such function. Letters are below U+0100, so one or two bytes each.
SPELLING = r"""
with recursive crc_table as (
  select list(list_reduce(range(9), lambda c, k: case when k = 0 then c else xor(c >> 1, 3988292384 * (c & 1)) end, v) order by v) as t from (select unnest(range(256)) as v)
), runs as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
), hashed as (
  select *, xor(list_reduce(flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)] else [192 | (ord(x) >> 6), 128 | (ord(x) & 63)] end)),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) as h
  from runs cross join crc_table where len(run) >= 5
), spelt as (
  select case when h % 97 = 0 then left(run, h % len(run)) || substring(run, h % len(run) + 2) else run end as word, n from hashed
), words as (
  select word, cast(sum(n) as bigint) as n from spelt where len(word) >= 5 group by word having sum(n) >= 3
), shorter as (
  select word, i, left(word, i) || substring(word, i + 2) as x from (select word, unnest(range(len(word))) as i from words)
), pairs as (
  select word, x as near from shorter where x in (select word from words)
  union select x, word from shorter where x in (select word from words)
  union select a.word, b.word from shorter a join shorter b on a.i = b.i and a.x = b.x and a.word <> b.word
), best as (
  select p.word, count(*) as n_near, max(w.n) as near_n, arg_max(p.near, (w.n, -1 * rank)) as near
  from pairs p join (select *, row_number() over (order by encode(word)) as rank from words) w on p.near = w.word group by p.word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 2 * w.n then b.near end as form, case when b.near_n >= 2 * w.n then b.near_n end as form_n
  from words w left join best b on w.word = b.word
), walks as (
  select word, word as at from forms
  union all select w.word, f.form from walks w join forms f on w.at = f.word where f.form is not null
), ends as (
  select w.word, w.at as root from walks w join forms f on w.at = f.word where f.form is null
)
select f.word, f.form, e.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from forms f join ends e on f.word = e.word
"""
