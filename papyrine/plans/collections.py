"""Queries over collections: summaries, identities, reconciliation, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import collapse
from papyrine.operators import catalog, identity, reconcile, rollout, store
from papyrine.operators.copydiff import number_text
from papyrine.plans import nearest as near
from papyrine.plans import sql as q
from papyrine.plans.content import current_chunks
from papyrine.sources.tables import load


def _key():
    """How document ids compare: collapsed, in lower case."""
    return collapse(F.lower("doc_id"))


def _collection():
    return F.coalesce("collection", F.lit("")).alias("collection")


def _manifest(spark, d) -> DataFrame:
    """The current manifest entry of each document of each collection."""
    m = load(spark, d, "manifest_docs").withColumn("doc_key", _key()).where("doc_key <> ''")
    return store.latest(m, ["collection", "doc_key"], ["updated_at", "entry_id"]).withColumn("collection", _collection())


def _registry(spark, d) -> DataFrame:
    r = load(spark, d, "registry_docs").withColumn("doc_key", _key()).where("doc_key <> ''")
    count = lambda c: number_text(F.col(c)).try_cast("decimal(38,9)").cast("bigint").alias(c)
    r = store.latest(r, ["collection", "doc_key"], ["updated_at", "entry_id"])
    return r.select(_collection(), "doc_key", "source_file", F.col("pdf_path").alias("local_file"), "source_sha256", count("chunks"), count("text_chunks"), count("table_chunks"))


def _store(spark, d) -> DataFrame:
    return reconcile.store_summary(current_chunks(spark, d).withColumn("doc_id", _key()).where("doc_id <> ''"))


def _in_collections(spark, d, rows: DataFrame) -> DataFrame:
    """Rows of the store, which has no collections, in each collection that names their document.

    A document that no collection names is in the one without a name.
    """
    named = _manifest(spark, d).select("collection", "doc_key").unionByName(_registry(spark, d).select("collection", "doc_key")).distinct()
    return rows.join(named, F.col("doc_id") == F.col("doc_key"), "left").drop("doc_key").withColumn("collection", _collection())


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _manifest(spark, d).select("collection", F.col("doc_key").alias("doc_id"), F.col("chunk_count").alias("chunks"), F.col("text_chunk_count").alias("text_chunks"), F.col("table_chunk_count").alias("table_chunks"))
    return _in_collections(spark, d, _store(spark, d)), m, _registry(spark, d).select("collection", F.col("doc_key").alias("doc_id"), *reconcile.COUNTS)


def _entries(spark, d) -> DataFrame:
    """Identities of the three sides, one row per collection, source and document."""
    names = {f: f for f in identity.FIELDS}
    c = _in_collections(spark, d, identity.identities(current_chunks(spark, d).withColumn("doc_id", _key()), "doc_id", names, "id")).withColumn("source", F.lit("store"))
    m = _manifest(spark, d).select("collection", F.col("doc_key").alias("doc_id"), *identity.FIELDS).withColumn("source", F.lit("manifest"))
    r = _registry(spark, d).select("collection", F.col("doc_key").alias("doc_id"), *identity.FIELDS).withColumn("source", F.lit("registry"))
    return c.unionByName(m).unionByName(r)


def _all_issues(spark, d) -> DataFrame:
    s, m, r = _sides(spark, d)
    return reconcile.issues(reconcile.three_way(s, m, r), _entries(spark, d), {"store": s, "manifest": m, "registry": r})


def doc_summary(spark, d):
    """Chunks of each document by type."""
    return _store(spark, d)


def manifest_current(spark, d):
    """Current manifest entries of each collection."""
    return catalog.current_manifest(load(spark, d, "manifest_docs")).select("collection", "doc_key", "entry_id", "chunk_count", "text_chunk_count", "table_chunk_count")


def manifest_totals(spark, d):
    """Documents and chunks of each collection."""
    return catalog.totals(catalog.current_manifest(load(spark, d, "manifest_docs")))


def version_issues(spark, d):
    """Entries made with other versions than the usual ones."""
    m = catalog.current_manifest(load(spark, d, "manifest_docs")).withColumn("doc_id", F.col("doc_key"))
    return catalog.version_issues(m, "ingestion_v2", "chunking_v2").select("collection", "doc_id", F.array_join("issues", ",").alias("issues"))


def doc_identities(spark, d):
    """First known identity values of each stored document."""
    return identity.identities(current_chunks(spark, d).withColumn("doc_id", _key()), "doc_id", {f: f for f in identity.FIELDS}, "id")


def _claimed(spark, d) -> DataFrame:
    return load(spark, d, "manifest_docs").withColumn("doc_id", _key()).where("doc_id <> ''").withColumn("collection", _collection())


def dup_identity(spark, d):
    """Identity values that several documents of a collection's manifest claim."""
    return identity.duplicates(_claimed(spark, d), by_source=False)


def dup_members(spark, d):
    """The documents that claim each such value."""
    return identity.duplicate_members(_claimed(spark, d), by_source=False)


def cleanup_plan(spark, d):
    """What to do about values that several documents of a collection claim, over all three sides."""
    return identity.cleanup_plan(_entries(spark, d))


def cleanup_members(spark, d):
    """What becomes of each of these documents."""
    return identity.cleanup_members(_entries(spark, d))


def canonical_ids(spark, d):
    """Intake items under the id by which their hash is known in the manifest."""
    have = load(spark, d, "manifest_docs").select("doc_id", "source_sha256", F.col("entry_id").alias("ordinal"))
    ask = load(spark, d, "registry_docs").select("doc_id", "source_sha256")
    return identity.canonical_ids(ask, have)


def ids_taken(spark, d):
    """Parsed intake items one of whose identities the manifest already has."""
    have = load(spark, d, "manifest_docs").select("doc_id", *identity.FIELDS)
    ask = load(spark, d, "registry_docs").select("doc_id", "source_file", F.col("pdf_path").alias("local_file"), "source_sha256").distinct()
    return identity.taken(ask, have)


def reconcile_docs(spark, d):
    """Documents missing on a side, or with different counts."""
    x = reconcile.presence_issues(reconcile.three_way(*_sides(spark, d)))
    return x.select("collection", "doc_id", "issue_type", F.array_join("present_in", ",").alias("present_in"), F.array_join("fields", ",").alias("fields"))


def count_sanity(spark, d):
    """Implausible counts in the store."""
    return reconcile.sanity_issues(_store(spark, d)).select("doc_id", F.array_join("checks", ",").alias("checks"))


def metadata_mismatch(spark, d):
    """Documents whose identities differ between the sides."""
    return reconcile.metadata_mismatches(_entries(spark, d)).select("collection", "doc_id", F.array_join("fields", ",").alias("fields"))


def issue_counts(spark, d):
    """Issues of each type."""
    return reconcile.issue_counts(_all_issues(spark, d))


def repair_plan(spark, d):
    """Repairs that the issues ask for."""
    return reconcile.repair_plan(_all_issues(spark, d)).select("collection", "action", "doc_id", "source", F.array_join("details", ",").alias("details"))


def registry_synced(spark, d):
    """Registry entries made from the manifest."""
    m = _manifest(spark, d).withColumn("doc_id", F.col("doc_key"))
    return catalog.registry_from_manifest(m)


def registry_totals(spark, d):
    """Documents and chunks of each collection of the registry made from the manifest."""
    return catalog.registry_totals(registry_synced(spark, d))


def registry_refused(spark, d):
    """Registry entries whose identity another document of their collection has in the manifest."""
    return catalog.refused_entries(registry_synced(spark, d), _registry(spark, d).select("collection", F.col("doc_key").alias("doc_id"), "source_file", F.col("local_file").alias("pdf_path"), "source_sha256"))


def rollout_gates(spark, d):
    """Gates over the state of all collections: rebuild, audit, evaluation of two searches, and overall."""
    m = _manifest(spark, d).withColumn("doc_id", F.col("doc_key"))
    failed = spark.createDataFrame([], "doc_id string, path string, error string")
    versions = catalog.version_issues(m, "ingestion_v2", "chunking_v2")
    gates = [
        rollout.rebuild_gate(m.where("collection = ''"), failed, ""),
        rollout.audit_gate(_all_issues(spark, d), identity.cleanup_plan(_entries(spark, d)), versions),
        rollout.eval_gate("evaluation", near.summary(spark, d, 10), near.summary(spark, d, 3)),
        rollout.spot_check_gate(load(spark, d, "eval_passages").select("query", F.when(F.size("labels") > 0, "pass").otherwise("fail").alias("status"))),
    ]
    return rollout.report(gates).select("gate", "status", F.array_join("issues", ",").alias("issues"))


QUERIES = {f.__name__: f for f in (doc_summary, manifest_current, manifest_totals, version_issues, doc_identities, dup_identity, dup_members, cleanup_plan, cleanup_members, canonical_ids, ids_taken, reconcile_docs, count_sanity, metadata_mismatch, issue_counts, repair_plan, registry_synced, registry_totals, registry_refused, rollout_gates)}

_K = q.collapse("lower(doc_id)")
_TEXT = lambda c: f"nullif({q.collapse(f'lower({c})')}, '')"
_PATH = lambda c: f"nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), chr(92), '/'), '/(\\./)+', '/', 'g'), '/{{2,}}', '/', 'g'), '^(\\./)+', ''), '(.)/$', '\\1')), '')"
_NORM = {"source_file": _TEXT("source_file"), "local_file": _PATH("local_file"), "source_sha256": _TEXT("source_sha256")}
_CUR = f"(select * exclude (rn) from (select *, {_K} as doc_key, row_number() over (partition by collection, {_K} order by updated_at desc nulls last, entry_id desc) as rn from manifest_docs where {_K} <> '') where rn = 1)"
_MAN = f"(select * replace (coalesce(collection, '') as collection) from {_CUR})"
_CNT = lambda c: f"try_cast(trim({c}) as decimal(38,9))::bigint"
_REG = f"(select coalesce(collection, '') as collection, doc_key, source_file, pdf_path as local_file, source_sha256, {_CNT('chunks')} as chunks, {_CNT('text_chunks')} as text_chunks, {_CNT('table_chunks')} as table_chunks from (select *, {_K} as doc_key, row_number() over (partition by collection, {_K} order by updated_at desc nulls last, entry_id desc) as rn from registry_docs where {_K} <> '') where rn = 1)"
_NAMED = f"(select collection, doc_key from {_MAN} union select collection, doc_key from {_REG})"
_IN = lambda t: f"(select coalesce(n.collection, '') as collection, t.* from {t} t left join {_NAMED} n on n.doc_key = t.doc_id)"
_STORE = f"(select {_K} as doc_id, count(*) as chunks, count_if(not coalesce(kind = 'table', false)) as text_chunks, count_if(coalesce(kind = 'table', false)) as table_chunks from {q.CHUNKS} where {_K} <> '' group by 1)"
_FIRST = lambda f: f"arg_min(trim(extra.{f}), (id, trim(extra.{f}))) filter (trim(extra.{f}) <> '')"
_IDS = f"(select {_K} as doc_id, {', '.join(f'{_FIRST(f)} as {f}' for f in identity.FIELDS)} from {q.CHUNKS} where {_K} <> '' group by 1)"
_ENTRIES = f"(select collection, 'store' as source, doc_id, source_file, local_file, source_sha256 from {_IN(_IDS)} union all select collection, 'manifest', doc_key, source_file, local_file, source_sha256 from {_MAN} union all select collection, 'registry', doc_key, source_file, local_file, source_sha256 from {_REG})"
_LONG = lambda t, keep: " union all ".join(f"select {keep}, '{f}' as field, {n} as norm from {t} where {n} is not null" for f, n in _NORM.items())
_BOTH = f"""(select coalesce(s.collection, m.collection, r.collection) as collection, coalesce(s.doc_id, m.doc_key, r.doc_key) as doc_id, s.doc_id is not null as in_s, m.doc_key is not null as in_m, r.doc_key is not null as in_r,
  {', '.join(f's.{c} as s_{c}, m.{n} as m_{c}, r.{c} as r_{c}' for c, n in (('chunks', 'chunk_count'), ('text_chunks', 'text_chunk_count'), ('table_chunks', 'table_chunk_count')))}
  from {_IN(_STORE)} s full join {_MAN} m on s.doc_id = m.doc_key and s.collection = m.collection full join {_REG} r on coalesce(s.doc_id, m.doc_key) = r.doc_key and coalesce(s.collection, m.collection) = r.collection)"""
_PRESENT = "array_to_string(list_filter([case when in_s then 'store' end, case when in_m then 'manifest' end, case when in_r then 'registry' end], lambda x: x is not null), ',')"
_DIFF = "array_to_string(list_filter([" + ", ".join(f"case when s_{c} is distinct from m_{c} or m_{c} is distinct from r_{c} then '{c}' end" for c in reconcile.COUNTS) + "], lambda x: x is not null), ',')"
_PRES = f"(select collection, doc_id, case when not (in_s and in_m and in_r) then 'missing_doc' else 'count_mismatch' end as issue_type, {_PRESENT} as present_in, case when in_s and in_m and in_r then {_DIFF} else '' end as fields from {_BOTH} where not (in_s and in_m and in_r) or {_DIFF} <> '')"


def _sanity(t: str, by: str = "collection") -> str:
    return f"""(select {f"{by}, " if by else ""}doc_id, array_to_string(list_filter([case when chunks <= 0 then 'no_chunks' end, case when text_chunks < 0 or table_chunks < 0 then 'negative_chunk_count' end, case when text_chunks + table_chunks <> chunks then 'count_breakdown_mismatch' end,
      case when chunks > 0 and text_chunks <= 0 then 'no_text_chunks' end, case when n >= 5 and med > 0 and chunks > 0 and chunks <= greatest(1, floor(med * 0.2)) then 'unusually_low_chunk_count' end,
      case when n >= 5 and med > 0 and chunks > 0 and chunks >= floor(med * 5) then 'unusually_high_chunk_count' end], lambda x: x is not null), ',') as checks
      from {t} t left join (select {f"{by}, " if by else ""}median(chunks) as med, count(*) as n from {t} where chunks > 0 {f"group by {by}" if by else ""}) {f"using ({by})" if by else "on true"})"""


_M3 = f"(select collection, doc_key as doc_id, chunk_count as chunks, text_chunk_count as text_chunks, table_chunk_count as table_chunks from {_MAN})"
_R3 = f"(select collection, doc_key as doc_id, chunks, text_chunks, table_chunks from {_REG})"
_META = "(select collection, doc_id, array_to_string(list_filter([" + ", ".join(f"case when count(distinct nullif(trim({f}), '')) > 1 then '{f}' end" for f in identity.FIELDS) + f"], lambda x: x is not null), ',') as fields from {_ENTRIES} group by collection, doc_id having count(distinct source) > 1)"
_DUPS = lambda keys, t: f"(select {keys}, count(distinct doc_id) as n_docs, min(doc_id) as first_doc_id from ({t}) group by {keys} having count(distinct doc_id) > 1)"
_ISSUES = f"""(select collection, issue_type, '' as source, doc_id, case when issue_type = 'missing_doc' then present_in else fields end as details from {_PRES}
  union all select collection, 'metadata_mismatch', '', doc_id, fields from {_META} where fields <> ''
  union all select collection, 'duplicate_identity', source, first_doc_id, '' from {_DUPS('collection, source, field, norm', _LONG(_ENTRIES, 'collection, source, doc_id'))}
  union all select collection, 'chunk_count_sanity', 'store', doc_id, checks from {_sanity(_IN(_STORE))} where checks <> '' union all select collection, 'chunk_count_sanity', 'manifest', doc_id, checks from {_sanity(_M3)} where checks <> '' union all select collection, 'chunk_count_sanity', 'registry', doc_id, checks from {_sanity(_R3)} where checks <> '')"""
_CLAIMED = f"(select coalesce(collection, '') as collection, {_K} as doc_id, source_file, local_file, source_sha256 from manifest_docs where {_K} <> '')"
_DUP_MAN = _DUPS("collection, field, norm", _LONG(_CLAIMED, "collection, doc_id"))
_WEIGHED = f"""with c as (select collection, field, norm, doc_id, count(distinct source) as k from ({_LONG(_ENTRIES, 'collection, source, doc_id')}) group by all),
      g as (select *, max(k) over (partition by collection, field, norm) as most, count(*) over (partition by collection, field, norm) as n_docs from c),
      h as (select collection, field, norm, max(n_docs) as n_docs, case when count_if(k = most) = 1 then max(doc_id) filter (k = most) end as keep_doc_id from g group by all having max(n_docs) > 1)"""
_CODE = lambda c: f"trim(coalesce({c}, ''))"
_SYNCED = f"""(select collection, doc_key as doc_id, {_CODE('local_file')} as pdf_path, {_CODE('source_file')} as source_file, coalesce(chunk_count, 0) as chunks, coalesce(text_chunk_count, 0) as text_chunks, coalesce(table_chunk_count, 0) as table_chunks,
      {_CODE('parser')} as parser, {_CODE('source_sha256')} as source_sha256, coalesce(file_size_bytes, 0) as file_size_bytes, {_CODE('ingestion_version')} as ingestion_version, trim(coalesce(chunker_version, chunking_version, '')) as chunker_version from {_MAN})"""
_AS = lambda t: f"(select collection, doc_id, source_file, pdf_path as local_file, source_sha256 from {t})"

_VERSIONS = f"""select * from (select collection, doc_key as doc_id, array_to_string(list_filter([case when trim(coalesce(ingestion_version, '')) not in ('', 'ingestion_v2') then 'ingestion_version' end,
      case when trim(coalesce(chunker_version, chunking_version, '')) not in ('', 'chunking_v2') then 'chunker_version' end], lambda x: x is not null), ',') as issues from {_CUR}) where issues <> ''"""

ORACLE = {
    "doc_summary": f"select * from {_STORE}",
    "manifest_current": f"select collection, doc_key, entry_id, chunk_count, text_chunk_count, table_chunk_count from {_CUR}",
    "manifest_totals": f"select collection, count(*) as doc_count, sum(chunk_count)::bigint as chunk_count, sum(text_chunk_count)::bigint as text_chunk_count, sum(table_chunk_count)::bigint as table_chunk_count from {_CUR} group by collection",
    "version_issues": _VERSIONS,
    "doc_identities": f"select * from {_IDS}",
    "dup_identity": f"select * from {_DUP_MAN}",
    "dup_members": f"select distinct collection, field, norm, doc_id from ({_LONG(_CLAIMED, 'collection, doc_id')}) join {_DUP_MAN} using (collection, field, norm)",
    "cleanup_plan": f"{_WEIGHED} select collection, field, norm, case when keep_doc_id is null then 'manual_review' else 'drop_duplicate_doc_ids' end as action, keep_doc_id, n_docs from h",
    "cleanup_members": f"{_WEIGHED} select collection, field, norm, doc_id, case when keep_doc_id is null then 'review' when doc_id = keep_doc_id then 'keep' else 'drop' end as role from c join h using (collection, field, norm)",
    "registry_synced": f"select * from {_SYNCED}",
    "registry_totals": f"select collection, count(*) as doc_count, sum(chunks)::bigint as chunk_count from {_SYNCED} group by collection",
    "registry_refused": f"""select distinct e.collection, e.doc_id, e.field, case when h.one <> e.doc_id then h.one else h.two end as existing_doc_id from ({_LONG(_AS(f"(select *, doc_key as doc_id, local_file as pdf_path from {_REG})"), 'collection, doc_id')}) e
      join (select collection, field, norm, min(doc_id) as one, max(doc_id) as two from ({_LONG(_AS(_SYNCED), 'collection, doc_id')}) group by all) h using (collection, field, norm) where h.one <> e.doc_id or h.two <> e.doc_id""",
    "canonical_ids": f"""select r.doc_id, coalesce(k.known, r.doc_id) as canonical_doc_id from registry_docs r left join (select {_NORM['source_sha256']} as h, arg_min(doc_id, (entry_id, doc_id)) as known from manifest_docs where {_NORM['source_sha256']} is not null group by 1) k on k.h = {_NORM['source_sha256'].replace('source_sha256', 'r.source_sha256')}""",
    "ids_taken": f"""with a as (select distinct doc_id, source_file, pdf_path as local_file, source_sha256 from registry_docs), x as ({_LONG('a', 'doc_id')} union all select doc_id, 'doc_id', {_TEXT('doc_id')} from a where {_TEXT('doc_id')} is not null),
      y as ({_LONG('manifest_docs', 'doc_id')} union all select doc_id, 'doc_id', {_TEXT('doc_id')} from manifest_docs where {_TEXT('doc_id')} is not null)
      select x.doc_id, x.field, min(y.doc_id) as existing_doc_id from x join y on x.field = y.field and x.norm = y.norm group by x.doc_id, x.field""",
    "reconcile_docs": f"select collection, doc_id, issue_type, present_in, fields from {_PRES}",
    "rollout_gates": f"""with v as (select count(*) as n from ({_VERSIONS})), i as (select count(*) as n from {_ISSUES}), u as (select count(*) as n from ({_WEIGHED} select * from h)), m as (select count(*) as n from {_MAN} where collection = ''),
      e as (select list_sort(list(case when delta is null then 'missing:' else 'dropped:' end || metric)) as bad from ({near.ORACLE["eval_gate"]}) where not passed),
      c as (select count(*) as n, count_if(not coalesce(len(labels) > 0, false)) as f from eval_passages),
      g as (select 'rebuild' as gate, case when n = 0 then 'missing_manifest' else '' end as issues from m
        union all select 'audit', array_to_string(list_filter([case when v.n > 0 then 'version_issues:' || v.n end, case when i.n > 0 then 'reconciliation_issues:' || i.n end, case when u.n > 0 then 'cleanup_entries:' || u.n end], lambda x: x is not null), ',') from v, i, u
        union all select 'evaluation', coalesce(array_to_string(bad, ','), '') from e
        union all select 'manual_spot_check', case when n = 0 then 'no_checks' when f > 0 then 'failed_checks:' || f else '' end from c)
      select gate, case when issues = '' then 'pass' else 'fail' end as status, issues from g
      union all select 'overall', case when count_if(issues <> '') > 0 then 'fail' else 'pass' end, coalesce(array_to_string(list_sort(list(gate) filter (issues <> '')), ','), '') from g""",
    "count_sanity": f"select * from {_sanity(_STORE, '')} where checks <> ''",
    "metadata_mismatch": f"select * from {_META} where fields <> ''",
    "issue_counts": f"select issue_type, count(*) as n from {_ISSUES} group by issue_type",
    "repair_plan": f"""select * from (select collection, case when issue_type = 'missing_doc' and contains(details, 'manifest') and not contains(details, 'registry') then 'sync_registry_from_manifest' when issue_type = 'metadata_mismatch' then 'review_doc_metadata'
      when issue_type = 'count_mismatch' then 'review_doc_counts' when issue_type = 'chunk_count_sanity' then 'inspect_parser_output' end as action, doc_id, source, details from {_ISSUES}) where action is not null""",
}
