"""Queries over texts, markdown, sections, tables and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import markdown as md
from papyrine.functions import layout, sections, tables
from papyrine.functions import text as tx
from papyrine.operators import chunking, retrieval
from papyrine.operators.store import latest
from papyrine.plans import sql as q
from papyrine.sources import sinks
from papyrine.sources.tables import computed_once, load


def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each chunk, its payload flat."""
    c = latest(load(spark, d, "chunks"), ["id"], ["ingested_at"])
    kind = F.lower(F.trim("chunk_type"))
    return c.select(
        "id", "content", "doc_id", kind.alias("chunk_type"), "parent_header", "page_number", "ingested_at",
        F.coalesce("extra.content_role", kind).alias("content_role"), F.col("extra.section_role").alias("section_role"), F.col("extra.is_low_value").alias("is_low_value"),
        F.coalesce("extra.parent_id", "id").alias("parent_id"), F.col("extra.table_index").alias("table_index"), F.col("extra.referenced_table_indices").alias("referenced_table_indices"),
        F.col("extra.source_file").alias("source_file"), F.col("extra.local_file").alias("local_file"), F.col("extra.source_sha256").alias("source_sha256"), F.col("extra.file_size_bytes").alias("file_size_bytes"),
    )


def parsed(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "parsed_documents").select("doc_id", "markdown_text", "tables", "parsed_at")
    by = F.struct("parsed_at", "markdown_text")
    return p.groupBy("doc_id").agg(F.max_by(F.struct("markdown_text", "tables"), by).alias("r")).select("doc_id", "r.*")


def chunks_current(spark, d):
    """Latest row of each chunk id."""
    return current_chunks(spark, d).select("id", "content", "doc_id", "chunk_type", "parent_header", "page_number", F.unix_micros("ingested_at").alias("ingested_us"))


def text_clean(spark, d):
    """Chunk contents without markup."""
    return load(spark, d, "chunks").select("id", tx.clean_markdown(F.col("content")).alias("cleaned"))


def text_citations(spark, d):
    """Chunk contents without numeric citations."""
    return load(spark, d, "chunks").select("id", tx.strip_citations(F.col("content")).alias("stripped"))


def text_parsed_clean(spark, d):
    """Freshly parsed markdown after its clean-up, with a heading before a structured abstract."""
    c = tx.structured_abstract(tx.clean_parsed(F.coalesce("markdown_text", F.lit(""))))
    return parsed(spark, d).select("doc_id", c.alias("cleaned"))


def text_sentences(spark, d):
    """Sentences of chunk contents."""
    return load(spark, d, "chunks").select("id", F.posexplode(tx.sentences(F.col("content"))).alias("pos", "sentence"))


def text_windows(spark, d):
    """Overlapping windows of two sentences."""
    c = load(spark, d, "chunks").select("id", tx.sentences(F.col("content")).alias("s"))
    return c.select("id", F.explode(tx.sentence_windows(F.col("s"))).alias("w")).select("id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), F.col("w.content").alias("content"))


def text_tokens(spark, d):
    """Token sets of documents: size and sorted words."""
    t = tx.token_set(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


def text_flags(spark, d):
    """Which chunk contents are references, front matter, low value or full of citations."""
    once = computed_once(load(spark, d, "chunks").select("id", tx.flat(F.col("content")).alias("flat")))
    c = F.col("flat")
    return once.select("id", tx.is_reference_block(c, True).alias("reference"), tx.is_front_matter_block(c, True).alias("front_matter"), tx.is_low_value(c, True).alias("low_value"), F.coalesce(tx.is_citation_heavy(c, True), F.lit(False)).alias("citation_heavy"))


def text_references(spark, d):
    """Tables and page that chunk contents name."""
    c = F.coalesce("content", F.lit(""))
    return load(spark, d, "chunks").select("id", F.array_join(F.transform(tx.table_references(c), lambda x: x.cast("string")), ",").alias("tables"), tx.page_number(c).alias("page"))


def text_overlap(spark, d):
    """Overlap of each chunk's words with those of its heading."""
    return load(spark, d, "chunks").select("id", F.round(tx.overlap(tx.token_set(F.col("content")), tx.token_set(F.col("parent_header"))), 6).alias("overlap"))


def md_blocks(spark, d):
    """Blocks, headings and table blocks of each parsed document."""
    b = md.blocks(F.col("markdown_text"))
    return parsed(spark, d).select("doc_id", F.size(b).alias("n_blocks"), F.size(F.filter(b, lambda x: md.heading_level(x) > 0)).alias("n_headings"), F.size(F.filter(b, md.is_table_block)).alias("n_tables"))


def md_headings(spark, d):
    """Headings with level and text."""
    b = parsed(spark, d).select("doc_id", F.posexplode(md.blocks(F.col("markdown_text"))).alias("pos", "block"))
    return b.select("doc_id", "pos", md.heading_level(F.col("block")).alias("level"), md.heading_text(F.col("block")).alias("heading")).where("level > 0")


def md_tables(spark, d):
    """Pipe tables: headers and rows, padded to the header's width."""
    t = parsed(spark, d).select("doc_id", F.posexplode(md.table_runs(F.col("markdown_text"))).alias("pos", "run"))
    h, rows = md.table_headers(F.col("run")), md.table_rows(F.col("run"))
    return t.select("doc_id", "pos", F.array_join(h, "|").alias("headers"), F.size(rows).alias("n_rows"), F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "\n").alias("cells"))


def md_table_csv(spark, d):
    """Pipe tables as quoted CSV with unique headers."""
    t = parsed(spark, d).select("doc_id", F.posexplode(md.table_runs(F.col("markdown_text"))).alias("pos", "run"))
    return t.select("doc_id", "pos", md.quoted_csv(md.unique_headers(md.table_headers(F.col("run"))), md.table_rows(F.col("run"))).alias("csv"))


def header_roles(spark, d):
    """Kinds of the headings that chunks stand under."""
    h = load(spark, d, "chunks").select("parent_header").distinct()
    c = F.col("parent_header")
    return h.select(
        "parent_header", sections.section_role(c).alias("section_role"), sections.header_kind(c).alias("kind"), sections.is_structural(c).alias("structural"),
        sections.is_non_structural(c).alias("non_structural"), F.array_join(sections.canonical_sections(c), ",").alias("canonical"),
    )


def table_semantics(spark, d):
    """What the parsed tables show, and their captions."""
    t = parsed(spark, d).select("doc_id", F.posexplode("tables").alias("pos", "t")).select("doc_id", "pos", F.coalesce("t.csv", F.lit("")).alias("csv"))
    none = F.array().cast("array<array<string>>")
    return t.select("doc_id", "pos", F.array_join(tables.semantics(F.col("csv")), ",").alias("semantics"), tables.caption(none, F.col("csv")).alias("caption"))


def table_trim(spark, d):
    """Parsed tables as matrices, title rows above the header taken off."""
    t = parsed(spark, d).select("doc_id", F.posexplode("tables").alias("pos", "t"))
    m = F.transform(tables.csv_cells(F.coalesce("t.csv", F.lit(""))), lambda x: F.transform(x, lambda c: F.nullif(F.trim(c), F.lit(""))))
    return t.select("doc_id", "pos", tables.trim_titles(m).alias("x")).select("doc_id", "pos", "x.trimmed", F.size("x.rows").alias("n_rows"), F.array_join(F.get("x.rows", F.lit(0)), "|").alias("header"))


def table_resolution(spark, d):
    """Whether a document's tables come from the parser or from its markdown."""
    p = parsed(spark, d)
    own = F.filter(F.coalesce("tables", F.array()), tables.has_content)
    x = p.select("doc_id", F.size(own).alias("n_parsed"), F.size(md.table_runs(F.col("markdown_text"))).alias("n_markdown"), tables.has_repeats(F.transform(own, lambda t: t["csv"])).alias("repeated"))
    return x.withColumn("origin", tables.origin(F.col("n_parsed"), F.col("n_markdown"), F.col("repeated")))


def text_segments(spark, d):
    """Segments of chunks' lines that wide blanks part, with their places."""
    lines = load(spark, d, "chunks").select("id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.select("id", "line_no", F.explode(layout.segments(F.col("line"))).alias("s")).select("id", "line_no", F.col("s.start").alias("start"), F.col("s.text").alias("segment"))


def table_cells(spark, d):
    """Cells of the parsed tables' CSV lines, quoted ones included."""
    t = parsed(spark, d).select("doc_id", F.posexplode("tables").alias("pos", "t"))
    c = t.select("doc_id", "pos", F.posexplode(tables.csv_cells(F.coalesce("t.csv", F.lit("")))).alias("row_no", "cells"))
    return c.select("doc_id", "pos", "row_no", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def chunk_documents(spark, d):
    """Chunks made from parsed documents."""
    return chunking.chunk_documents(parsed(spark, d)).drop("parent_content")


def chunk_summary(spark, d):
    """Chunks made per document and type."""
    return chunking.chunk_documents(parsed(spark, d)).groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"))


def chunk_table_links(spark, d):
    """Contexts linked to the tables of parsed documents."""
    return chunking.table_links(chunking.chunk_documents(parsed(spark, d)))


def query_plan(spark, d):
    """What the evaluation questions ask for."""
    p = retrieval.plan_queries(load(spark, d, "eval_passages").select("query_id", "query"))
    return p.select("query_id", "prefers_tables", "requires_tables", "requires_metric_tables", "prefers_metadata", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), F.array_join("families", ",").alias("families"))


def retrieve_candidates(spark, d):
    """Chunks that share most words with each question."""
    planned = retrieval.plan_queries(load(spark, d, "eval_passages").select("query_id", "query"))
    return retrieval.lexical_candidates(planned, retrieval.eligible(current_chunks(spark, d)))


def retrieve_vectors(spark, d):
    """Chunks nearest to each question among those that its conditions admit."""
    planned = retrieval.plan_queries(load(spark, d, "eval_passages").select("query_id", "query"))
    return retrieval.vector_candidates(planned, retrieval.eligible(current_chunks(spark, d)))


def returned_content(spark, d):
    """What is shown of each chunk made from parsed documents."""
    made = chunking.chunk_documents(parsed(spark, d))
    links = chunking.table_links(made).withColumnRenamed("contexts", "linked_contexts")
    return retrieval.returned(made.join(links, ["doc_id", "table_index"], "left")).select("id", "content")


def retrieve_answers(spark, d):
    """Ranked and diversified answers of the evaluation questions."""
    return retrieval.retrieve(load(spark, d, "eval_passages").select("query_id", "query"), current_chunks(spark, d)).drop("content")


def eligible_chunks(spark, d):
    """Chunks that may answer any question."""
    return retrieval.eligible(current_chunks(spark, d)).select("id", "doc_id", "content_role", "section_role")


def export_payload(spark, d):
    """Export rows whose payload is read back from its JSON text."""
    rows = sinks.export_records(current_chunks(spark, d))
    get = lambda k: F.get_json_object("payload", f"$.{k}").alias(k)
    return rows.select("id", "doc_id", "chunk_type", "parent_header", "page_number", "content", get("content_role"), get("section_role"), get("source_file"), get("source_sha256"), get("table_index").cast("int"))


QUERIES = {
    f.__name__: f
    for f in (
        chunks_current, text_clean, text_citations, text_parsed_clean, text_sentences, text_windows, text_tokens, text_flags, text_references, text_overlap, md_blocks, md_headings, md_tables, md_table_csv, header_roles,
        table_semantics, table_trim, table_resolution, table_cells, text_segments, chunk_documents, chunk_summary, chunk_table_links, query_plan, retrieve_candidates, retrieve_vectors, retrieve_answers, returned_content, eligible_chunks, export_payload,
    )
}

_LINES = "list_filter(list_transform(string_split({b}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_PIPES = "(length({x}) - length(replace({x}, '|', '')))"
_B = f"string_split_regex({q.strip('coalesce(markdown_text, ' + chr(39) * 2 + ')')}, '\\n\\s*\\n')"
_FIRST = "trim(string_split(b, chr(10))[1])"
_ISTABLE = f"(len({_LINES.format(b='b')}) >= 2 and len(list_filter({_LINES.format(b='b')}, lambda x: {_PIPES.format(x='x')} < 2)) = 0 and coalesce(regexp_matches({_LINES.format(b='b')}[2], {q.quoted(md.DIVIDER)}), false))"
_SPLIT = "list_transform(string_split(regexp_replace(trim({x}), '^\\|+|\\|+$', '', 'g'), '|'), lambda y: trim(y))"
_RUNS = f"""select doc_id, generate_subscripts(runs, 1) - 1 as pos, unnest(runs) as run from (
  select doc_id, list_filter(list_transform(string_split_regex(array_to_string(list_transform(string_split(coalesce(markdown_text, ''), chr(10)), lambda x: case when {_PIPES.format(x='x')} >= 2 then trim(x) else '' end), chr(10)), '\\n{{2,}}'),
    lambda b: list_filter(string_split(b, chr(10)), lambda x: x <> '')), lambda r: len(r) >= 2 and coalesce(regexp_matches(r[2], {q.quoted(md.DIVIDER)}), false)) as runs from {q.PARSED})"""
_H = "lower(trim(coalesce(parent_header, '')))"
_HT = "trim(coalesce(parent_header, ''))"
_NW = f"len(list_filter(string_split_regex({_HT}, '\\s+'), lambda w: w <> ''))"
_CANON = q.collapse("translate(regexp_replace(" + q.collapse("lower(coalesce(parent_header, ''))") + f", {q.quoted(sections.NUMBERING)}, ''), '|/', '  ')")
_ELIGIBLE = f"""(select *, coalesce(extra.content_role, kind) as content_role, extra.section_role as section_role from {q.CHUNKS}
  where not coalesce(coalesce(extra.content_role, kind) in ('reference', 'front_matter'), false) and not coalesce(extra.section_role in ('references', 'front_matter', 'unknown'), false) and not coalesce(extra.is_low_value, false)
  and not (length({q.collapse("coalesce(content, '')")}) < 30 or {q.score('content', tx.LOW_VALUE_PATTERNS)} >= 2))"""
_Q = "lower(coalesce(query, ''))"
_QT = f"list_filter({q.tokens('coalesce(query, ' + chr(39) * 2 + ')', 3)}, lambda t: t not in ({', '.join(map(q.quoted, tx.QUERY_STOP_WORDS))}))"
_TEXT_TOK = "coalesce(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda t: length(t) > 3)), [])"

_CSV = """list_transform(string_split(array_to_string(list_transform(string_split(csv, '"'), lambda x, i: case when i % 2 = 1 then replace(replace(x, ',', chr(1)), chr(10), chr(2)) else x end), '"'), chr(2)),
  lambda r: list_transform(string_split(r, chr(1)), lambda c: case when length(trim(c)) >= 2 and starts_with(trim(c), '"') and ends_with(trim(c), '"') then replace(substr(trim(c), 2, length(trim(c)) - 2), '""', '"') else c end))"""
_TABLES = f"(select doc_id, generate_subscripts(tables, 1)::int - 1 as pos, coalesce(unnest(tables).csv, '') as csv from {q.PARSED})"
_CELLS = "list_transform(t, lambda c: nullif(trim(c), ''))"
_LOW = "list_filter(list_transform(list_filter(r, lambda x: x is not null), lambda x: lower(trim(x))), lambda x: x <> '')"


def _parsed_clean(x: str) -> str:
    """Clean-up of freshly parsed markdown. A pattern with a word character at both ends is replaced twice, since matches can't overlap."""
    sub = lambda x, p, by: f"regexp_replace({x}, {q.quoted(p)}, {q.quoted(by)}, 'g')"
    x = sub(x, r"(?i)<!--\s*image\s*-->", " ")
    for _ in range(2):
        x = sub(x, r"([\pL\pN_\pM])[ \t]{2,}([\pL\pN_\pM])", "\\1 \\2")
    for parts, any_case, after in tx.PARTED:
        lead = ("(?i)" if any_case else "") + r"([A-Za-z])\s+" + r"\s+".join(parts)
        x = sub(x, lead + (r"\s+([A-Za-z]{2,}\b)" if "?=" in after else after), "\\1" + "".join(parts) + (" \\2" if "?=" in after else ""))
    x = sub(x, tx.INLINE_CITATION, "")
    x = sub(x, r"\s+([,.;:!?])", "\\1")
    x = sub(x, r"[ \t]+\n", "\n")
    return q.strip(sub(x, r"\n{3,}", "\n\n"))


#: Unique headers of a pipe table's first line, and its cells as CSV.
_NAMED = "list_transform(h, lambda x, i: case when x = '' then 'column_' || i else x end)"
_UNIQUE = "list_transform(nh, lambda x, i: case when len(list_filter(nh[1:i], lambda y: y = x)) > 1 then x || ' (' || len(list_filter(nh[1:i], lambda y: y = x)) || ')' else x end)"
_CELL = """list_transform({r}, lambda x: case when regexp_matches(x, '[",\n\r]') then '"' || replace(x, '"', '""') || '"' else x end)"""

ORACLE = {
    "md_table_csv": f"""select doc_id, pos::int as pos, array_to_string(list_concat([array_to_string({_CELL.format(r=_UNIQUE)}, ',')], list_transform(run[3:], lambda y: array_to_string({_CELL.format(r=f"list_resize({_SPLIT.format(x='y').replace('lambda y:', 'lambda z:').replace('trim(y))', 'trim(z))')}, len(h), '')")}, ','))), chr(10)) as csv
      from (select *, {_NAMED} as nh from (select *, {_SPLIT.format(x='run[1]')} as h from ({_RUNS})))""",
    "table_trim": f"""select doc_id, pos, trimmed::int as trimmed, (len(m) - trimmed)::int as n_rows, array_to_string(m[trimmed + 1], '|') as header from (select *, case when mode > 1 then coalesce(list_position(sure, true) - 1, 0) else 0 end as trimmed from (
      select *, list_transform(top, lambda r: not ((len(list_filter(r, lambda x: x is not null)) <= greatest(1, floor(mode * {tables.SPARSE})) and len(list_filter(r, lambda x: x is not null)) < mode)
          or coalesce(len({_LOW}) > 0 and len(list_distinct({_LOW})) / greatest(len({_LOW}), 1) <= {tables.LOW_VARIANCE}, false))
        and len(list_filter(r, lambda x: x is not null)) >= mode and len(list_filter({_LOW}, lambda x: regexp_matches(x, '\\p{{L}}'))) / greatest(len({_LOW}), 1) >= {tables.TEXT_SHARE}) as sure from (
        select *, list_sort(list_transform(list_distinct(source), lambda n: {{'times': -len(list_filter(source, lambda y: y = n)), 'n': n}}))[1].n as mode from (
          select *, case when len(list_filter(density, lambda n: n > 1)) > 0 then list_filter(density, lambda n: n > 1) else density end as source from (
            select *, list_transform(top, lambda r: len(list_filter(r, lambda x: x is not null))) as density from (select doc_id, pos, m, m[1:{tables.WINDOW_ROWS}] as top from (
              select doc_id, pos, list_transform({_CSV}, lambda r: list_transform(r, lambda c: nullif(trim(c), ''))) as m from {_TABLES})))))))""",
    "text_parsed_clean": f"""select doc_id, case when first is null then c else array_to_string(flatten(list_transform(ls, lambda x, i: case when i = first then ['## Structured Abstract', trim(x)] else [x] end)), chr(10)) end as cleaned from (
      select *, list_filter(marks, lambda k: k < body)[1] as first from (
        select doc_id, c, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(lower(trim(x)), '^##\\s+(methods|results|discussion|introduction|conclusion)\\b')), true), least(len(ls), 80) + 1) as body,
          list_filter(list_transform(ls, lambda x, i: case when regexp_matches(lower(trim(x)), '^(background|methods|results|conclusions?)\\.') then i end), lambda x: x is not null) as marks
        from (select doc_id, c, string_split(c, chr(10)) as ls from (select doc_id, {_parsed_clean("coalesce(markdown_text, '')")} as c from {q.PARSED}))))""",
    "table_cells": f"select doc_id, pos, generate_subscripts(c, 1)::int - 1 as row_no, len(unnest(c))::int as n_cells, array_to_string(unnest(c), '|') as cells from (select doc_id, pos, {_CSV} as c from {_TABLES})",
    "table_resolution": f"""select doc_id, n_parsed::int as n_parsed, n_markdown::int as n_markdown, repeated, case when n_parsed = 0 then 'markdown' when n_markdown > n_parsed then 'markdown' when n_markdown > 0 and repeated then 'markdown' else 'parser' end as origin from (
      select doc_id, len(own) as n_parsed, coalesce(n, 0) as n_markdown, len(k) > len(list_distinct(k)) as repeated from (
        select doc_id, own, list_filter(list_transform(own, lambda t: {q.collapse("lower(coalesce(t.csv, ''))")}), lambda x: x <> '') as k from (
          select doc_id, list_filter(coalesce(tables, []), lambda t: len(list_filter(coalesce(t.rows, []), lambda r: len(list_filter(map_values(r), lambda v: trim(v) <> '')) > 0)) > 0) as own from {q.PARSED}))
      left join (select doc_id, count(*) as n from ({_RUNS}) group by doc_id) m using (doc_id))""",
    "text_segments": """select id, line_no, length(array_to_string(parts[1:i - 1], ''))::int as start, parts[i] as segment from (select id, line_no, parts, unnest(range(1, len(parts) + 1)) as i from (
      select id, generate_subscripts(ls, 1)::int - 1 as line_no, regexp_extract_all(unnest(ls), '[^ \\t\\r\\f\\x0b]+(?:[ \\t\\r\\f\\x0b][^ \\t\\r\\f\\x0b]+)*|[ \\t\\r\\f\\x0b]+') as parts from (select id, string_split(coalesce(content, ''), chr(10)) as ls from chunks)))
      where regexp_matches(parts[i], '[^ \\t\\r\\f\\x0b]')""",
    "chunks_current": f"select id, content, doc_id, kind as chunk_type, parent_header, page_number, epoch_us(ingested_at) as ingested_us from {q.CHUNKS}",
    "text_clean": f"select id, {q.clean('content')} as cleaned from chunks",
    "text_citations": f"select id, regexp_replace(content, {q.quoted(tx.INLINE_CITATION)}, '', 'g') as stripped from chunks",
    "text_sentences": f"select id, generate_subscripts(s, 1)::int - 1 as pos, unnest(s) as sentence from (select id, {q.sentences('content')} as s from chunks)",
    "text_windows": f"""select id, w_start, least(w_start + 2, len(s))::int as w_end, array_to_string(s[w_start + 1 : w_start + 2], ' ') as content from (
      select id, s, unnest(list_filter(range(0, greatest(len(s), 1)), lambda k: k = 0 or k + 1 < len(s)))::int as w_start from (select id, {q.sentences('content')} as s from chunks))""",
    "text_tokens": f"select doc_id, len(t)::int as n_tokens, array_to_string(list_sort(t), ' ') as tokens from (select doc_id, {q.tokens('text')} as t from documents)",
    "text_flags": f"""select id, {q.score('content', tx.REFERENCE_PATTERNS)} >= 2 as reference, {q.score('content', tx.FRONT_MATTER_PATTERNS)} >= 2 as front_matter,
      length({q.collapse("coalesce(content, '')")}) < 30 or {q.score('content', tx.LOW_VALUE_PATTERNS)} >= 2 as low_value,
      coalesce({q.score('content', tx.CITATION_PATTERNS)} + len(regexp_extract_all({q.collapse('lower(content)')}, '\\[[0-9,\\s]+\\]')) >= 2, false) as citation_heavy from chunks""",
    "text_references": """select id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(content, ''), '(?i)\\btable\\s+(\\d+)\\b', 1), lambda x: try_cast(x as int)), lambda x: x is not null))), ',') as tables,
      try_cast(nullif(regexp_extract(coalesce(content, ''), '(?i)\\bpage\\s*(\\d+)\\b', 1), '') as int) as page from chunks""",
    "text_overlap": f"select id, case when least(len(a), len(b)) > 0 then round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) else 0.0 end as overlap from (select id, {q.tokens('content')} as a, {q.tokens('parent_header')} as b from chunks)",
    "md_blocks": f"""select doc_id, len(bs)::int as n_blocks, len(list_filter(bs, lambda b: regexp_matches({_FIRST}, '^(#{{1,6}})\\s+(.*)$')))::int as n_headings, len(list_filter(bs, lambda b: {_ISTABLE}))::int as n_tables
      from (select doc_id, {_B} as bs from {q.PARSED})""",
    "md_headings": f"""select doc_id, pos, length(regexp_extract({_FIRST}, '^(#{{1,6}})\\s+(.*)$', 1))::int as level, trim(regexp_extract({_FIRST}, '^(#{{1,6}})\\s+(.*)$', 2)) as heading
      from (select doc_id, generate_subscripts(bs, 1)::int - 1 as pos, unnest(bs) as b from (select doc_id, {_B} as bs from {q.PARSED})) where regexp_matches({_FIRST}, '^(#{{1,6}})\\s+(.*)$')""",
    "md_tables": f"""select doc_id, pos::int as pos, array_to_string(h, '|') as headers, (len(run) - 2)::int as n_rows,
      coalesce(array_to_string(list_transform(run[3:], lambda x: array_to_string(list_resize({_SPLIT.format(x='x')}, len(h), ''), '|')), chr(10)), '') as cells
      from (select *, {_SPLIT.format(x='run[1]')} as h from ({_RUNS}))""",
    "header_roles": f"""select parent_header, case when {_H} in ('unknown', '') then 'unknown' when {q.any_of(_H, ('reference', 'bibliograph'))} then 'references' when {q.any_of(_H, sections.FRONT_MATTER)} then 'front_matter' else 'body' end as section_role,
      case when {_HT} = '' then 'opening_metadata' when regexp_matches(lower({_HT}), {q.quoted(sections.CITATION_LIKE)}) then 'citation_like' when {_NW} <= 4 and regexp_matches({_HT}, '^[A-Za-z0-9&/\\- ]+$') then 'subsection'
        when upper({_HT}) = {_HT} and lower({_HT}) <> {_HT} and {_NW} <= 8 then 'subsection' else 'title_like' end as kind,
      {_H} not in ('unknown', '') and {q.any_of(_H, sections.STRUCTURAL)} as structural,
      {q.collapse("lower(coalesce(parent_header, ''))")} = '' or not {q.any_of(q.collapse("lower(coalesce(parent_header, ''))"), sections.STRUCTURAL)} as non_structural,
      array_to_string(list_filter([{', '.join(f"case when regexp_matches({_CANON}, {q.quoted(p)}) then '{s}' end" for s, p in sections.CANONICAL)}], lambda x: x is not null), ',') as canonical
      from (select distinct parent_header from chunks)""",
    "table_semantics": f"""select doc_id, pos, array_to_string(list_filter([case when regexp_matches(lower(csv), {q.quoted(tables.METRIC_WORDS)}) and regexp_matches(lower(csv), {q.quoted(tables.QUANTITIES)}) then 'metric' end,
      case when regexp_matches(lower(csv), {q.quoted(tables.COMPARISON)}) then 'comparison' end, case when regexp_matches(lower(csv), {q.quoted(tables.COUNTS)}) then 'count' end], lambda x: x is not null), ',') as semantics,
      left(coalesce({_LINES.format(b='csv')}[1], ''), 240) as caption from (select doc_id, generate_subscripts(tables, 1)::int - 1 as pos, coalesce(unnest(tables).csv, '') as csv from {q.PARSED})""",
    "query_plan": f"""select query_id, {q.any_of('lower(coalesce(query, ' + chr(39) * 2 + '))', retrieval.TABLE_SIGNALS)} as prefers_tables, {q.any_of('lower(coalesce(query, ' + chr(39) * 2 + '))', ('table', 'tabular'))} as requires_tables,
      {q.any_of('lower(coalesce(query, ' + chr(39) * 2 + '))', ('table', 'tabular'))} and {q.any_of('lower(coalesce(query, ' + chr(39) * 2 + '))', retrieval.METRIC_SIGNALS)} as requires_metric_tables,
      {q.any_of('lower(coalesce(query, ' + chr(39) * 2 + '))', retrieval.METADATA_SIGNALS)} as prefers_metadata, array_to_string(list_sort({_QT}), ' ') as tokens,
      array_to_string(list_filter([{', '.join(f"case when {' and '.join(q.any_of('lower(query)', c) for c in f.clauses)} then '{f.name}' end" for f in retrieval.FAMILIES)}], lambda x: x is not null), ',') as families from eval_passages""",
    "retrieve_candidates": f"""select * from (select query_id, id, shared, row_number() over (partition by query_id order by shared desc, id)::int as place from (
      select query_id, id, count(*) as shared from (select id, unnest({_TEXT_TOK}) as t from {_ELIGIBLE}) join (select query_id, unnest({_QT}) as t from eval_passages) using (t) group by all)) where place <= {retrieval.CANDIDATES}""",
    "retrieve_vectors": f"""with c as (select id, coalesce(content_role = 'table', false) as tab, coalesce(extra.referenced_table_indices, []) as refs, {q.embedding("coalesce(content, '')")} as v from {_ELIGIBLE} where id is not null),
      a as (select query_id, {q.any_of(_Q, retrieval.TABLE_SIGNALS)} as pt, {q.any_of(_Q, ('table', 'tabular'))} as rt, {q.any_of(_Q, ('table', 'tabular'))} and {q.any_of(_Q, retrieval.METRIC_SIGNALS)} as rm,
        list_transform(regexp_extract_all(coalesce(query, ''), '(?i)\\btable\\s+(\\d+)\\b', 1), lambda x: try_cast(x as int)) as ix, {q.embedding("coalesce(query, '')")} as v from eval_passages),
      s as (select query_id, id, pt, round(list_cosine_similarity(a.v::double[], c.v::double[]), 6) as score from a, c where case when tab then pt else not rm and (not rt or (case when len(ix) > 0 then len(list_intersect(refs, ix)) > 0 else len(refs) > 0 end)) end
        and len(list_filter(a.v, lambda x: x <> 0)) > 0 and len(list_filter(c.v, lambda x: x <> 0)) > 0)
      select query_id, id, score, place from (select *, row_number() over (partition by query_id order by score desc, id)::int as place from s) where place <= case when pt then 60 else 40 end""",
    "eligible_chunks": f"select id, doc_id, content_role, section_role from {_ELIGIBLE}",
    "export_payload": f"""select id, doc_id, kind as chunk_type, parent_header, page_number, content, coalesce(extra.content_role, kind) as content_role, extra.section_role as section_role, extra.source_file as source_file,
      extra.source_sha256 as source_sha256, extra.table_index as table_index from {q.CHUNKS}""",
}
