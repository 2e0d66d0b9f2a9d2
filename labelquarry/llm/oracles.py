"""SQL (DuckDB) for the operators whose results SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = r"'[\x20\x09-\x0D]+'"

SUFFIX_DECONTAMINATION = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select cast(item_id as varchar) as item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_window as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)
), doc_window as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from item_window))
), found as (
  select r, i, n, item_id from doc_window join item_window using (n, k)
), hit as (
  select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as j from found) group by r
), items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct r, item_id from found) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""

BOTTOM_K_NEAR_DEDUP = rf"""
with recursive d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array({_LOWER}, {_BLANKS}), lambda x: x <> '') as w from documents
), shingle as (
  select distinct r, array_to_string(w[i : i + 4], ' ') as s
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), size as (
  select r, count(*) as n from shingle group by r
), pair as (
  select a.r as a, b.r as b, count(*) as shared from shingle a join shingle b using (s) where a.r <> b.r group by a.r, b.r
), link as (
  select a, b from pair join size x on x.r = a join size y on y.r = b where 100 * shared >= 75 * (x.n + y.n - shared)
), reach as (
  select r, r as other from d
  union
  select reach.r, link.b from reach join link on link.a = reach.other
), component as (
  select reach.r, min(o.doc_id) as component_id from reach join d o on o.r = reach.other group by reach.r
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d join component using (r) left join size using (r)
"""

SUPERKMER_SUBSTRINGS = rf"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_BLANKS}), lambda x: x <> '') as w from documents
), windows as (
  select r, i, array_to_string(w[i : i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from d)
), gone as (
  select distinct r, unnest(range(i, i + 35)) as j
  from (select r, i from windows join (select k from windows group by k having count(*) > 1) using (k))
), word as (
  select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d
), kept as (
  select r, count(*) as n, string_agg(word, ' ' order by j) as text from word anti join gone using (r, j) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r)
"""

FILTER_ORDERS = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), {_BLANKS}), lambda x: x <> '') as w
  from documents
), smallest as (
  select text, min(doc_id) as least from d group by text
), failed as (
  select r, doc_id, part, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] as f
  from d join smallest using (text)
), label as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), p as (
  select part, f, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
  from failed left join label using (doc_id) group by all
), a as (select unnest(range(1, 6)) as i), orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o
  from a, a as b, a as c, a as d, a as e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), placed as (
  select p.*, o, s.i as step, f[o[s.i]] as now, list_bool_or(list_transform(o[1 : s.i - 1], lambda x: f[x])) as earlier
  from p, orders, a as s
), told as (
  select part, o, step,
    sum(n) filter (not now and not coalesce(earlier, false)) as kept,
    sum(n) filter (now and not coalesce(earlier, false)) as removed,
    sum(n) filter (now and coalesce(earlier, false)) as redundant,
    sum(n) filter (now and len(list_filter(f, lambda x: x)) = 1) as unique_fails,
    sum(n) filter (now and not coalesce(earlier, false) and good) as good_lost,
    sum(n) filter (now and not coalesce(earlier, false) and toxic) as toxic_lost
  from placed group by part, o, step
)
select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, cast(step as int) as step,
  cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, o[step]), 0) as bigint) as shapley
from told
"""

SEEKABLE_FIM = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), drawn as (
  select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from d
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), part as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1 : b], '') as m, array_to_string(u[b + 1 : n], '') as s from cut
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(len(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(len(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from part
"""


def _disclosure() -> str:
    """The plain patterns and counts of every (entity, term) pair, without filters or digests."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 0 THEN cast({digits}[i] as int) "
        f"ELSE 2 * cast({digits}[i] as int) - CASE WHEN cast({digits}[i] as int) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    )
    valid = {
        "email": "true", "ip": "list_max(list_transform(string_split(value, '.'), lambda p: cast(p as hugeint))) <= 255",
        "card": f"len({digits}) between 14 and 19 and {luhn}", "phone": f"len({digits}) between 10 and 15",
    }

    def matches(source: str, pattern: str) -> str:
        return f"""
  select r, gap, value, cast(sum(len(gap) + len(value)) over (partition by r order by i) as bigint) - len(value) as start
  from (select r, i, gaps[i] as gap, found[i] as value from (
    select r, gaps, found, unnest(range(1, len(found) + 1)) as i from (
      select r, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as found from {source})))"""

    kinds = " union all ".join(
        f"select r, '{k}' as kind, {rank} as rank, value, start, start + len(value) as stop from ({matches('d', p)}) where {valid[k]}"
        for rank, (k, p) in enumerate(patterns.items()))
    word = r"[\p{L}\p{N}]+"

    def terms(column: str) -> str:
        w = f"list_distinct(list_transform(regexp_extract_all({column}, '{word}'), lambda w: lower(w)))"
        return f"list_distinct(list_concat({w}, list_transform({w}, lambda w: w[1:2] || '*')))"

    line = "kind || ':' || start || ':' || stop"
    return rf"""
with d as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), base as materialized ({kinds}
), mention as (
  select r, text, kind || ':' || CASE WHEN kind in ('card', 'phone') THEN {digits} ELSE lower(value) END as entity,
    CASE WHEN start > 200 THEN regexp_replace(substring(text, start - 199, 200), '^{word}', '') ELSE substring(text, 1, start) END || ' ' ||
    CASE WHEN stop + 200 < len(text) THEN regexp_replace(substring(text, stop + 1, 200), '{word}$', '') ELSE substring(text, stop + 1) END as near
  from base join d using (r)
), entity as (
  select entity, count(distinct r) as n_entity from mention group by entity having count(distinct text) >= 2
), pair as (
  select entity, n_entity, term, count(distinct r) as n_both
  from (select r, text, entity, n_entity, unnest({terms('near')}) as term from mention join entity using (entity))
  group by entity, n_entity, term having count(distinct text) >= 2
), met as (
  select term, count(*) as n_term from (select unnest({terms('text')}) as term from d) group by term
), strength as (
  select term, max(CASE WHEN n_entity < total THEN 1 + ln(n_both / n_term) / ln(total / n_entity) ELSE 0 END) as disclosure
  from pair join met using (term), (select count(*) as total from d) group by term
), flagged as (
  select term from strength where disclosure >= 0.95 and not contains(term, '*')
), place as (
  select r, 'term' as kind, 4 as rank, start, start + len(value) as stop from ({matches('d', word)}) join flagged on lower(value) = term
), span as (
  select r, kind, rank, start, stop from base
  union all
  select * from place p where not exists (select 1 from base b where b.r = p.r and b.start < p.stop and p.start < b.stop)
), told as (
  select r, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
    count(*) filter (kind = 'phone') as n_phone, string_agg({line}, ',' order by start, rank) filter (rank < 4) as base_line,
    string_agg({line}, ',' order by start, rank) as spans
  from span group by r
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base_line, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (r)
"""


DISCLOSURE = _disclosure()
