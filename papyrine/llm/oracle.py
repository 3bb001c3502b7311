"""SQL for the queries that plain SQL can express."""

from __future__ import annotations

from papyrine.llm import quality

_TRIM = "trim({x}, ' \t\r\n')"


def _current(table: str, kind: str, id_col: str, text: str, at: str, limit: int) -> str:
    n = f"coalesce(length({_TRIM.format(x=text)}), 0)"
    return f"""select '{kind}' as item_kind, item_id, t, {limit} as lim from (
      select {id_col} as item_id, {text} as t, {n} as n,
        row_number() over (partition by {id_col} order by {at} desc nulls last, {n} desc, {text} desc nulls last) as rn from {table})
      where rn = 1 and n > {limit}"""


def _fits(pattern_parts: str) -> str:
    return f"list_max(list_transform({pattern_parts}, lambda x: length({_TRIM.format(x='x')}))) <= lim"


_MARK = "regexp_replace(t, '([.!?])[ \t\r]+([A-Z0-9])', '\\1' || chr(10) || '\\2', 'g')"
P5_FOUND = f"""
with items as ({_current('chunks', 'chunk', 'id', 'content', 'ingested_at', 900)} union all {_current('parsed_documents', 'document', 'doc_id', 'markdown_text', 'parsed_at', 6000)})
select item_kind, item_id, case
  when {_fits("regexp_split_to_array(t, '\n([ \t\r]*\n)+')")} then 'paragraph'
  when {_fits("string_split(t, chr(10))")} then 'line'
  when {_fits(f"string_split({_MARK}, chr(10))")} then 'sentence'
  else 'hard' end as cut
from items"""

#: Earlier items that each item matches, then items in order: one that matches no accepted item is accepted.
P4_FOUND = """
with recursive raw as (select item_id, abstract_text, nullif(trim(regexp_replace(lower(source_sha256), '\\s+', ' ', 'g')), '') as k1, nullif(trim(regexp_replace(lower(source_file), '\\s+', ' ', 'g')), '') as k2,
    nullif(trim(regexp_replace(lower(doc_id), '\\s+', ' ', 'g')), '') as k3, regexp_extract_all(lower(coalesce(abstract_text, '')), '[\\p{L}\\p{N}]+') as w from intake_items where item_id is not null),
  items as (select item_id, k1, k2, k3, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s, row_number() over (order by item_id) as rn from raw),
  runs as (select item_id, len(s) as n, unnest(s) as r from items),
  near as (select a.item_id as a, b.item_id as b from runs a join runs b on a.r = b.r and a.item_id < b.item_id and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4 group by a.item_id, b.item_id, a.n, b.n having count(*) * 9 >= (a.n + b.n) * 4),
  pairs as (select a, b from near union select x.item_id, y.item_id from items x join items y on x.item_id < y.item_id and (x.k1 = y.k1) union select x.item_id, y.item_id from items x join items y on x.item_id < y.item_id and x.k2 = y.k2
    union select x.item_id, y.item_id from items x join items y on x.item_id < y.item_id and x.k3 = y.k3),
  asked as materialized (select i.rn, i.item_id, coalesce(list(p.a) filter (p.a is not null), []) as before from items i left join pairs p on p.b = i.item_id group by i.rn, i.item_id),
  taken as (select 0::bigint as rn, []::bigint[] as acc, null::bigint as kept, null::bigint as item
    union all select a.rn, case when len(list_intersect(t.acc, a.before)) = 0 then list_append(t.acc, a.item_id) else t.acc end, list_min(list_intersect(t.acc, a.before)), a.item_id from taken t join asked a on a.rn = t.rn + 1)
select kept as kept_id, item as dup_id from taken where kept is not null"""

WORD_STATISTICS = "doc_id n_chars n_words n_lines mean_word_length letter_share digit_share vowel_share common_word_share distinct_word_share distinct_words single_char_share long_token_share".split()
_BLANK = "[\\s\\x0b" + "".join(f"\\x{{{ord(c):x}}}" for c in quality.BLANKS) + "]+"
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.COMMON)
_LEFT = "length(regexp_replace(t, '{p}', '', 'g'))"
_SHARE = lambda a, b: f"case when {b} > 0 then least({a} / {b}, 1.0) else 0.0 end"
P8_WORDS = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
  w as (select doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') as w from d),
  c as (select doc_id, length(t) as n_chars, len(w) as n_words, len(regexp_extract_all(t, '[^\\s\\x0b][^\\n]*')) as n_lines, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as solid, len(list_distinct(w)) as distinct_words,
    {_LEFT.format(p='[^\\p{L}]+')} as letters, {_LEFT.format(p='\\P{Nd}+')} as digits, {_LEFT.format(p=quality.PATTERNS['not_vowels'])} as vowels,
    len(list_filter(w, lambda x: length(x) <= {quality.LONGEST_COMMON} and lower(x) in ({_COMMON}))) as common, len(list_filter(w, lambda x: length(x) = 1)) as single,
    coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) > 24), lambda x: length(x))), 0) as long from w)
select doc_id, n_chars, n_words, n_lines, case when n_words > 0 then solid / n_words else 0.0 end as mean_word_length, {_SHARE('letters', 'solid')} as letter_share, {_SHARE('digits', 'solid')} as digit_share, {_SHARE('vowels', 'letters')} as vowel_share,
  {_SHARE('common', 'n_words')} as common_word_share, {_SHARE('distinct_words', 'n_words')} as distinct_word_share, distinct_words, {_SHARE('single', 'n_words')} as single_char_share, {_SHARE('long', 'solid')} as long_token_share from c"""

ORACLE = {"p8_words": P8_WORDS, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
