"""Pieces of SQL that several counterpart queries share."""

from __future__ import annotations

from papyrine.functions import text as tx

#: Blanks as the engine's Unicode-aware patterns see them.
WS = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def clean(x: str) -> str:
    for pattern, by in tx.CLEANING:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return strip(x)


def score(x: str, patterns: tuple[str, ...]) -> str:
    flat = collapse(f"lower({x})")
    return "(" + " + ".join(f"coalesce(regexp_matches({flat}, {quoted(p)})::int, 0)" for p in patterns) + ")"


def any_of(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def tokens(x: str, longer: int = 2) -> str:
    return f"coalesce(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > {longer})), [])"


def sentences(x: str) -> str:
    flat = collapse(f"coalesce({x}, '')")
    return f"list_filter(string_split(regexp_replace({flat}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


def embedding(x: str) -> str:
    """Signed counts of hashed words, as the default embedder gives them."""
    hashes = f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::bigint)"
    return f"(select list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(hs, lambda h: h % 64 = d), lambda h: case when h // 256 % 2 = 1 then 1 else -1 end)), 0)::int) from (select {hashes} as hs))"


#: Current rows of chunks, by the same order as the engine's.
CHUNKS = """(select * exclude (rn), lower(trim(chunk_type)) as kind from (
  select *, row_number() over (partition by id order by ingested_at desc nulls last, content desc nulls last, doc_id desc nulls last, chunk_type desc nulls last, parent_header desc nulls last, page_number desc nulls last) as rn
  from chunks) where rn = 1)"""
#: Current rows of parsed documents.
PARSED = """(select * exclude (rn) from (
  select doc_id, markdown_text, tables, parsed_at, row_number() over (partition by doc_id order by parsed_at desc nulls last, markdown_text desc nulls last) as rn from parsed_documents) where rn = 1)"""
