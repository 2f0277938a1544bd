"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP9 = """
with w as (
  select doc_id, md5(coalesce(text, '')) as k,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), i as (
  select item_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from benchmark
), ds as (
  select distinct doc_id, k, unnest(
    case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as s
  from w
  union
  -- runs of as many words as a short item has
  select distinct doc_id, k, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) as s
  from w, (select distinct len(w) as n from i where len(w) between 1 and 4) where len(w.w) >= n
), its as (
  select distinct item_id, unnest(
    case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as s
  from i
), sized as (
  select item_id, s, count(*) over (partition by item_id) as n_item from its
), pairs as (
  select doc_id, k, item_id, n_item, count(*) as n_shared
  from ds join sized using (s) group by all
)
select doc_id, item_id, max(n_item) as n_item, max(n_shared) as n_shared
from pairs where n_shared >= 0.8 * n_item - 1e-9 group by doc_id, item_id
"""


OP4 = """
with d as (
  select doc_id, source, md5('mix' || coalesce(cast(doc_id as varchar), '')) as draw,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda a: a <> ''))
      as size
  from documents
), s as (
  select source, sum(size)::bigint as words,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end
      as w
  from d group by source
), r as (
  select *, 2 * words as cap, 2 * words / w::double as ratio, sum(words) over () as total from s
), k as (
  select *, sum(cap) over (order by ratio, source nulls last) as caps,
    sum(w) over () - sum(w) over (order by ratio, source nulls last) as open_w,
    lead(ratio) over (order by ratio, source nulls last) as next_ratio
  from r
), unit as (
  -- twice the words left for the sources that stay open, and their weights
  select 3 * total as twice, sum(w) as open_w, min(ratio) as next_ratio from r group by total
  union all
  select 3 * total - 2 * caps, open_w, next_ratio from k where open_w > 0
), best as (
  select twice, open_w from unit where twice <= next_ratio * 2 * open_w order by twice desc limit 1
), t as (
  select source, words, case when (select count(*) from best) = 0
      or cap * 2 * (select open_w from best) < (select twice from best) * w then cap::double
    else ((select twice from best) * w) / (2 * (select open_w from best))::double end as target
  from r
), p as (
  select *, case when words = 0 then 0 else floor(target)::bigint // words end as full_passes,
    case when words = 0 then 0 else floor(target)::bigint % words end as rest from t
), placed as (
  select d.doc_id, d.size, p.words as source_size, p.target, p.full_passes, p.rest,
    coalesce(sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from d join p on d.source is not distinct from p.source
)
select doc_id, size::bigint as size, source_size, target,
  (size * (full_passes + case when 2 * before + size <= 2 * rest then 1 else 0 end))::bigint as taken
from placed
"""

OP5 = """
with t as (
  select row_number() over () as k, doc_id, coalesce(text, '') as x from documents
), w as (
  select k, unnest(ws) as w, generate_subscripts(ws, 1) as p
  from (select k, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') as ws
        from t)
), three as (
  select k, p, w,
    lead(w, 1) over (partition by k order by p) as w2, lead(w, 2) over (partition by k order by p) as w3
  from w
), found as (
  select k, p, w3 is not null and count(*) over (partition by k, w, w2, w3) > 1 as again from three
), covered as (
  select k, count(*) as n_words, count(*) filter (where again or again1 or again2) as n_repeat_words
  from (select k, again, lag(again, 1, false) over (partition by k order by p) as again1,
          lag(again, 2, false) over (partition by k order by p) as again2 from found)
  group by k
), lines as (
  select k, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(every) as n_lines,
    len(list_filter(every, lambda a: ends_with(a, '...'))) as n_broken,
    len(list_filter(every, lambda a: regexp_matches(a, '^[\\x20\\t]*[-*\\x{2022}]'))) as n_items, n_plain
  from (select k, string_split(x, chr(10)) as every,
          len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'),
            lambda a: a <> '' and not regexp_matches(a, '\\p{L}'))) as n_plain,
          list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) as ls
        from t)
), s as (
  select t.k, doc_id, x, coalesce(n_words, 0) as n_words,
    length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as n_symbols,
    n_dup_lines, n_lines, n_broken, n_items, n_plain, coalesce(n_repeat_words, 0) as n_repeat_words
  from t left join covered using (k) join lines using (k)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or n_symbols * 5 > n_words * 2 or n_dup_lines * 2 > n_lines
    or length(regexp_replace(x, '\\p{L}+', '', 'g')) * 2 > length(x)
    or length(regexp_replace(x, '[0-9]+', '', 'g')) * 10 < length(x) * 7
    or length(regexp_replace(x, '[A-Z]+', '', 'g')) * 2 < length(x)
    or n_plain * 2 > n_words or n_broken * 10 > n_lines * 3 or n_items * 10 > n_lines * 9) as kept
from s
"""


OP2 = """
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
    (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), t as (
  select *, regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g')
      as shown_role,
    regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') as shown
  from given
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
    filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || shown_role || chr(10) || shown || '<|im_end|>' || chr(10)))::bigint
    as formatted_chars
from t group by conv_id
"""

OP6 = """
with d as (
  select row_number() over () as k, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), c as (
  select k, len(h) // 2 as n, h, unnest(range(0, len(h) // 2 - 199, 1000)) as c from d
  where len(h) >= 400
), piece as (
  select k, n, c, substr(h, 2 * c + 1, 2400) as piece from c
), p as (
  select k, c, piece, unnest(range(0, least(1000, n - 199 - c))) as o from piece
), w as (
  select k, c + o as p, count(*) over (partition by md5(substr(piece, 2 * o + 1, 400))) > 1 as again
  from p
), starts as (
  select k, p, p > 200 + coalesce(lag(p) over (partition by k order by p), -1000) as fresh
  from w where again
), runs as (
  select k, p, sum(fresh::integer) over (partition by k order by p) as run from starts
), spans as (
  select k, run, min(p) as s, max(p) + 200 as e from runs group by k, run
), pieces as (
  select k, s, e, coalesce(lag(e) over (partition by k order by s), 0) as before,
    row_number() over (partition by k order by s desc) = 1 as last_one from spans
), cut as (
  select k, sum(e - s)::bigint as n_removed, count(*) as n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s)
      || max(case when last_one then substr(h, 2 * e + 1) end) as kept
  from pieces join d using (k) group by k
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed,
  coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut using (k)
"""

OP10 = """
with recursive d as (
  select row_number() over () as k, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct k, unnest(
    case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as s
  from d
), n as (
  select k, count(*) as n from s group by k
), met as (
  select a.k as a, b.k as b, count(*) as shared from s a join s b on a.s = b.s and a.k <> b.k group by all
), links as (
  select a, b from met join n x on x.k = a join n y on y.k = b
  where shared >= 0.8 * (x.n + y.n - shared) - 1e-9
), reach(a, b) as (
  select k, k from d union select a, k from (select reach.a, links.b as k from reach join links on links.a = reach.b)
), classed as (
  select reach.a as k, min(d.doc_id) as class_id from reach join d on d.k = reach.b group by 1
)
select doc_id, class_id, coalesce(n_links, 0) as n_links
from d join classed using (k)
left join (select a as k, count(*) as n_links from links group by a) using (k)
"""

OP11 = """
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place
  from conversations
), hurt as (
  select *, xor(list_reduce([ascii(c) for c in string_split(place, '')], lambda crc, byte:
      list_reduce(range(8), lambda x, bit: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(crc, byte::bigint)),
      4294967295::bigint), 4294967295) % 20 as h
  from given
), rows_ as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when h = 3 then [0, 1] else [0] end) as copy
  from hurt where h <> 0
), numbered as (
  select *, substr(role, 1, 1) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as nr,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again
  from rows_
), r as (
  select *, shown = '' as blank, shown <> '' and again as duplicate,
    shown <> '' and not again and right(shown, 1) not in ('.', '!', '?') as truncated,
    case when shown <> '' and not again and right(shown, 1) not in ('.', '!', '?') then 5 else 0 end as extra
  from numbered
), ids as (select distinct conv_id from conversations),
dp as (
  -- least cost (eight digits) and audit by state: nothing, system, user, assistant
  select conv_id, 0::bigint as nr, '00000000' as e, null::varchar as s, '00000005I' as u, '00000010II' as a from ids
  union all
  select conv_id, nr, e, s, u, least(a, printf('%08d', substr(u, 1, 8)::int + 5) || substr(u, 9) || 'I') as a
  from (
    select conv_id, nr, e, s, a, least(u,
      printf('%08d', substr(e, 1, 8)::int + 5) || substr(e, 9) || 'I',
      printf('%08d', substr(s, 1, 8)::int + 5) || substr(s, 9) || 'I',
      printf('%08d', substr(a, 1, 8)::int + 5) || substr(a, 9) || 'I') as u
    from (
      select dp.conv_id, r.nr,
        printf('%08d', substr(e, 1, 8)::int + 2) || substr(e, 9) || 'D' as e,
        least(printf('%08d', substr(s, 1, 8)::int + 2) || substr(s, 9) || 'D',
          case when not blank and not duplicate and i = 's' then printf('%08d', substr(e, 1, 8)::int + extra) || substr(e, 9) || 'K' end) as s,
        least(printf('%08d', substr(u, 1, 8)::int + 2) || substr(u, 9) || 'D',
          case when not blank and not duplicate then printf('%08d', substr(least(e, s, a), 1, 8)::int + extra + case when i = 'u' then 0 else 1 end)
            || substr(least(e, s, a), 9) || case when i = 'u' then 'K' else 'R' end end) as u,
        least(printf('%08d', substr(a, 1, 8)::int + 2) || substr(a, 9) || 'D',
          case when not blank and not duplicate then printf('%08d', substr(u, 1, 8)::int + extra + case when i = 'a' then 0 else 1 end)
            || substr(u, 9) || case when i = 'a' then 'K' else 'R' end end) as a
      from dp join r on r.conv_id is not distinct from dp.conv_id and r.nr = dp.nr + 1
    )
  )
), counted as (
  select conv_id, max(nr) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
    count(*) filter (where truncated) as truncated
  from r group by conv_id
), pairs as (
  select conv_id, count(*) filter (where nr > 1 and before || i not in ('su', 'ua', 'au')) as illegal
  from (select conv_id, nr, i, lag(i) over (partition by conv_id order by nr) as before from r) group by conv_id
), best as (
  select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, least(e, a) as v
  from ids
  left join counted c on c.conv_id is not distinct from ids.conv_id
  left join pairs p on p.conv_id is not distinct from ids.conv_id
  join dp on dp.conv_id is not distinct from ids.conv_id and dp.nr = coalesce(c.n, 0)
), letters as (
  select conv_id, unnest(string_split(substr(v, 9), '')) as letter, generate_subscripts(string_split(substr(v, 9), ''), 1) as j
  from best where length(v) > 8
), placed as (
  select *, sum((letter <> 'I')::int) over w as nr, sum((letter <> 'D')::int) over w as o
  from letters window w as (partition by conv_id order by j)
), out_ as (
  select p.conv_id, j, o, letter, role, text, first_value(letter = 'K' and i = 's') over (partition by p.conv_id order by j) as with_system
  from placed p left join r on letter <> 'I' and r.conv_id is not distinct from p.conv_id and r.nr = p.nr
  where letter <> 'D'
), texts as (
  select conv_id, string_agg(case when letter = 'K' then role when (o - with_system::int) % 2 = 1 then 'user' else 'assistant' end
      || ':' || case when letter = 'I' then '' else text end, chr(10) order by j) as t
  from out_ group by conv_id
)
select b.conv_id, gaps::bigint as gaps, blank, duplicate, truncated, illegal, substr(v, 1, 8)::bigint as cost, substr(v, 9) as audit,
  sha256(coalesce(t, '')) as repaired_sha256
from best b left join texts on texts.conv_id is not distinct from b.conv_id
"""

OP12 = """
with letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') as w,
    min(doc_id) over (partition by coalesce(text, '')) as least
  from documents
), marked as (
  select part,
    case when len(w) < 200 then 'A' else '' end
      || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
      || case when 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 3 * length(x) then 'C' else '' end
      || case when regexp_matches(x, '[#$%&*|]') then 'D' else '' end
      || case when doc_id > least then 'E' else '' end as fails,
    doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good,
    doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic
  from d
), g as (
  select part, fails, count(*) as n, count(*) filter (where good) as good,
    count(*) filter (where toxic) as toxic
  from marked group by part, fails
), met as (
  select part, filter_order, step, substr(filter_order, step, 1) as f, fails, n, good, toxic,
    length(translate(substr(filter_order, 1, step - 1), fails, '')) = step - 1 as here,
    contains(fails, substr(filter_order, step, 1)) as failing
  from g, orders, (select unnest(range(1, 6))::int as step)
), r as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (where here and not failing), 0)::bigint as kept,
    coalesce(sum(n) filter (where here and failing), 0)::bigint as removed,
    coalesce(sum(n) filter (where not here and failing), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = f), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where here and failing), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where here and failing), 0)::bigint as toxic_lost
  from met group by part, filter_order, step, f
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from r
"""

OP13 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest,
    max(page_id) over (partition by coalesce(html, '')) as best
  from pages
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id is distinct from best then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from best then best end as refers_to
from p
"""


def all_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": OP2,
        "op6_suffix_array_dedup": OP6,
        "op10_ngram_jaccard_join": OP10,
        "op4_source_mixing": OP4,
        "op5_quality_rules": OP5,
        "op9_benchmark_decontamination": OP9,
        "op11_conversation_repair": OP11,
        "op12_filter_interactions": OP12,
        "op13_warc": OP13,
    }
