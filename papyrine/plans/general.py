"""Queries of the general data-pipeline operators (copies, drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import copydiff, drift
from papyrine.sources.tables import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries missing on one side and differing fields, by name."""
    return p2_values(spark, d).select("collection", "doc_id", "field")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with both sides' values."""
    return copydiff.manifest_registry_differences(load(spark, d, "manifest_docs"), load(spark, d, "registry_docs"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Differences per collection and field."""
    return p2_values(spark, d).groupBy("collection", "field").agg(F.count("*").alias("n"))


def p2_peeling(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of the lookup tables, and how many couldn't be peeled, by peeling."""
    return copydiff.peeling_report(load(spark, d, "manifest_docs"), load(spark, d, "registry_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of fields from file to file."""
    return drift.changes(load(spark, d, "manifest_files"))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one typed table, with what didn't fit rescued."""
    return drift.ingest(load(spark, d, "manifest_files"))


QUERIES = {f.__name__: f for f in (p2_found, p2_values, p2_summary, p2_peeling, p3_found, p3_table)}

_NUM = "case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) <> '' then coalesce(cast(try_cast(trim({c}) as decimal(38,9)) as varchar), 'text:' || lower(trim({c}))) end"
_FOLD = "nullif(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '')"


def _side(table: str, counts: tuple[str, str, str]) -> str:
    n = [f"{_NUM.format(c=f'cast({c} as varchar)')} as {m}" for c, m in zip(counts, ("chunk_count", "text_chunk_count", "table_chunk_count"))]
    return f"""select * exclude (rn) from (
      select collection, {_FOLD.format(c="doc_id")} as doc_id, {", ".join(n)}, {_FOLD.format(c="source_sha256")} as source_sha256,
        row_number() over (partition by collection, {_FOLD.format(c="doc_id")} order by updated_at desc nulls last, entry_id desc) as rn
      from {table}) where rn = 1 and doc_id is not null"""


def _values_sql() -> str:
    fields = ("chunk_count", "text_chunk_count", "table_chunk_count", "source_sha256")
    parts = [
        "select coalesce(a.collection, b.collection) as collection, coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'missing_in_manifest' else 'missing_in_registry' end as field, cast(null as varchar) as manifest_value, cast(null as varchar) as registry_value from a full join b on a.collection is not distinct from b.collection and a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null",
        *[
            f"select a.collection, a.doc_id, '{f}', a.{f}, b.{f} from a join b on a.collection is not distinct from b.collection and a.doc_id = b.doc_id where a.{f} is distinct from b.{f}"
            for f in fields
        ],
    ]
    return f"with a as ({_side('manifest_docs', ('chunk_count', 'text_chunk_count', 'table_chunk_count'))}), b as ({_side('registry_docs', ('chunks', 'text_chunks', 'table_chunks'))}) " + " union all ".join(parts)


#: Fields of each file with the type of most values; fields that vanished and came at once compared by
#: value; and the last known type carried from file to file, under a former name too.
_CHANGES = """
with recursive rec as (select * from manifest_files where coalesce(json_valid(payload), false) and json_type(payload) = 'OBJECT'),
  e as (select collection, file_name, written_at, row_id, payload ->> '$.doc_id' as doc, k as field, json_extract(payload, '$."' || k || '"') as v from (select *, unnest(json_keys(payload)) as k from rec)),
  t as (select *, case json_type(v) when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'float' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' end as kind from e),
  n as (select collection, file_name, written_at, field, kind, count(*) as c from t group by all),
  s as (select collection, file_name, written_at, field, arg_max(kind, (c, -ascii(kind))) filter (kind is not null) as kind from n group by all),
  o as (select collection, file_name, row_number() over (partition by collection order by written_at, file_name) as seq from (select distinct collection, file_name, written_at from s)),
  p as (select s.collection, s.file_name, seq, field, kind from s join o on s.collection is not distinct from o.collection and s.file_name = o.file_name),
  gone as (select p.collection, p.seq + 1 as seq, field from p join o on o.collection is not distinct from p.collection and o.seq = p.seq + 1 where not exists (from p y where y.collection is not distinct from p.collection and y.seq = p.seq + 1 and y.field = p.field)),
  come as (select collection, file_name, seq, field from p where seq > 1 and not exists (from p y where y.collection is not distinct from p.collection and y.seq = p.seq - 1 and y.field = p.field)),
  val as (select t.collection, seq, field, doc, arg_max(v, row_id) as v from t join o on t.collection is not distinct from o.collection and t.file_name = o.file_name where kind is not null and doc is not null group by all),
  agree as (select g.collection, g.seq, g.field as old, c.field as new, avg((a.v = b.v)::int) as share, count(*) as k from gone g join come c on g.collection is not distinct from c.collection and g.seq = c.seq
    join val a on a.collection is not distinct from g.collection and a.seq = g.seq - 1 and a.field = g.field join val b on b.collection is not distinct from g.collection and b.seq = g.seq and b.field = c.field and b.doc = a.doc group by all having share > 0.5),
  moved as (select collection, seq, old, new from agree qualify row_number() over (partition by collection, seq, old order by share desc, k desc, new) = 1 and row_number() over (partition by collection, seq, new order by share desc, k desc, old) = 1),
  before as materialized (select p.*, coalesce(m.old, case when c.field is null and p.seq > 1 then p.field end) as former from p left join come c on c.collection is not distinct from p.collection and c.seq = p.seq and c.field = p.field
    left join moved m on m.collection is not distinct from p.collection and m.seq = p.seq and m.new = p.field),
  known as (select collection, file_name, seq, field, kind as last, null::varchar as earlier, kind from before where former is null
    union all select b.collection, b.file_name, b.seq, b.field, coalesce(b.kind, k.last), k.last, b.kind from known k join before b on b.collection is not distinct from k.collection and b.seq = k.seq + 1 and b.former = k.field)
select file_name, '' as old_field, field as new_field, 'added' as change from come c where not exists (from moved m where m.collection is not distinct from c.collection and m.seq = c.seq and m.new = c.field)
union all select o.file_name, g.field, '', 'removed' from gone g join o on o.collection is not distinct from g.collection and o.seq = g.seq where not exists (from moved m where m.collection is not distinct from g.collection and m.seq = g.seq and m.old = g.field)
union all select o.file_name, m.old, m.new, 'renamed' from moved m join o on o.collection is not distinct from m.collection and o.seq = m.seq
union all select file_name, field, field, 'type_changed' from known where kind is not null and earlier is not null and kind <> earlier"""

ORACLE = {
    "p3_found": _CHANGES,
    "p2_values": _values_sql(),
    "p2_found": f"select collection, doc_id, field from ({_values_sql()})",
    "p2_summary": f"select collection, field, count(*) as n from ({_values_sql()}) group by all",
}
