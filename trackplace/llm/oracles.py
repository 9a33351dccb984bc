"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

# Fixed values, written out here so that a changed constant does not change both sides.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

OP2 = f"""
with doc as (
  select row_number() over () as k, doc_id, text, md5(coalesce(text, '')) as digest,
    coalesce(source, chr(0)) as site, string_split(text, chr(10)) as ls
  from documents),
line as (
  select k, doc_id, digest, site, unnest(range(1, len(ls) + 1)) as pos,
    unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) as bare
  from doc where text is not null),
long_line as (select * from line where len(regexp_extract_all(bare, '{WORD}')) >= 1),
spread as (
  select bare, count(distinct site) as sites, min(struct_pack(doc_id := doc_id, digest := digest, pos := pos)) as f
  from long_line group by bare having count(distinct site) >= 3),
gone as (
  select l.k, list(l.pos) as gone_at, count(*) as n from long_line l join spread s on l.bare = s.bare
  where not (l.doc_id is not distinct from s.f.doc_id and l.digest = s.f.digest and l.pos = s.f.pos) group by l.k)
select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, coalesce(n, 0) as n_removed,
  case when n is null then text else array_to_string(
    list_filter(ls, lambda x, i: not list_contains(gone_at, i)), chr(10)) end as text
from doc left join gone on doc.k = gone.k
"""

_STOP_WORDS = (
    "the of and to in is that for with on be by this as are was it an or from der die und in den von zu das"
    " mit sich des auf für ist im dem nicht ein eine als de la le et les des en un du une que est pour qui dans"
    " a par plus pas au el los y del se las por con para su al lo como o si sobre este"
)
_STOPS = ", ".join(f"'{w}'" for w in _STOP_WORDS.split())
OP9 = f"""
with doc as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls
  from documents),
win as (
  select k, i, w[i:i + 4] as g
  from (select k, w, unnest(range(1, len(w) - 3)) as i from doc)),
rep as (select k, i from (select k, i, count(*) over (partition by k, g) as n from win) where n > 1),
cover as (
  select k, sum(least(coalesce(nxt - i, 5), 5)) as n
  from (select k, i, lead(i) over (partition by k order by i) as nxt from rep) group by k),
m as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '{SPACE}', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    length(t) - length(replace(t, '!', '')) as n_shouts,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_upper,
    len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') in ({_STOPS}))) as n_stops,
    len(ls) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from doc left join cover c on doc.k = c.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and word_chars / n_words between 2 and 16 and n_symbols / n_words <= 0.1 and n_shouts / n_words <= 0.2
    and n_upper / word_chars <= 0.6 and n_dup_lines / n_lines <= 0.4 and (n_words < 30 or n_stops / n_words >= 0.02) as kept
from m
"""

OP10 = f"""
with doc as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as digest
  from documents),
sums as (
  select source, cast(sum(size) as bigint) as source_size,
    [5, 2, 1][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1] as w
  from doc group by source),
levels as (
  select *, 3 * source_size / w as lim,
    ((sum(source_size) over ()) - coalesce(sum(3 * source_size) over (
      order by 3 * source_size / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 3 * source_size / w, encode(source) nulls last
      rows between current row and unbounded following) as level
  from sums),
goal as (
  select source, source_size, case when lim <= level or share is null then cast(3 * source_size as double)
    else share * w end as target
  from levels, (select min(struct_pack(lim := lim, s := encode(source), level := level)).level as share
    from levels where lim > level) x),
plan as (
  select *, 512 as block, cast(ceil(source_size / 512) as bigint) as blocks,
    coalesce(cast(floor(target / nullif(source_size, 0)) as bigint), 0) as passes,
    sum(cast(floor(target) as hugeint)) over (order by encode(source) nulls last
      rows between unbounded preceding and current row) as upto, sum(cast(floor(target) as hugeint)) over () as whole
  from goal),
need as (
  select *, passes * blocks + cast(ceil(greatest(floor(target) - passes * source_size, 0) / 512) as bigint) as needed,
    cast((upto * 2147483648) // nullif(whole, 0) as bigint) as high from plan),
span as (select *, coalesce(lag(high) over (order by encode(source) nulls last), 0) as low from need),
total as (select cast(sum(needed) as bigint) as n from need),
hit as (
  select source, slot, needed, row_number() over (partition by source order by slot) - 1 as rank
  from (select unnest(range(n)) as slot from total), span
  where (slot % 2147483648) * 1327217885 % 2147483648 >= low and (slot % 2147483648) * 1327217885 % 2147483648 < high),
placed as (
  select doc_id, size, d.source, source_size, target, passes,
    coalesce(sum(size) over (partition by d.source order by digest, doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as pos
  from doc d join plan g on d.source is not distinct from g.source),
took as (
  select *, cast(passes * size + greatest(
    0, least(pos + size, floor(target) - passes * source_size) - pos) as bigint) as taken from placed)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then coalesce(h.slot, (select n from total)) end as first_slot
from took t left join hit h on t.source is not distinct from h.source and h.rank = pos // 512 and h.rank < h.needed
"""

OP11 = """
with doc as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d
  from documents),
drawn as (
  select *, len(u) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
    cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from doc),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
part as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s
  from cut)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
    else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from part
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP12 = f"""
with doc as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(text, {_LOWER}), '{TERM}') as u
  from documents where text is not null),
total as (select count(*) filter (len(u) > 0) as big_n, cast(sum(len(u)) as bigint) as l from doc),
tf as (select k, x as term, count(*) as tf from (select k, unnest(u) as x from doc) group by k, x),
df as (select term, count(*) as df from tf group by term),
item as (
  select i, item_id, x as term, count(*) as reps
  from (select i, item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{TERM}')) as x
    from (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark)))
  group by i, item_id, x),
scored as (
  select i, item_id, doc_id, tf.k, cast(sum(reps * cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(u) * big_n) // l)))) as bigint) as score
  from item join df using (term) join tf using (term) join doc on tf.k = doc.k, total
  group by i, item_id, doc_id, tf.k),
ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as r from scored where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked where r <= 20
"""

ORACLES = {
    "op2_line_dedup": OP2, "op9_quality_rules": OP9, "op10_source_mix": OP10, "op11_fill_in_middle": OP11,
    "op12_lexical_search": OP12,
}
