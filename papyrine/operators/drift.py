"""Reading records whose fields drift from file to file into one table.

Records are parsed into variants. Per file, the fields and the types of their values are
counted where they are read (a summary far smaller than the records). Only where a field
vanished and another came at once are files read again, and only those fields' values,
as hashes, are compared document by document, to tell a renaming from a removal and an
addition. A fold over a collection's summary gives the list of changes and, for each
file, the meaning of each field name. Ingestion enforces the target schema: what fits
goes to typed columns, every unknown or uncastable field is kept in a rescue column as
JSON, fields whose renaming is approved are promoted, and rescued values are replayed into
the typed columns.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyrine.sources.tables import durable

#: Target schema: one column per meaning, in the types that ingestion enforces.
TARGET: Mapping[str, str] = {
    "doc_id": "string",
    "source_file": "string",
    "local_file": "string",
    "chunk_count": "bigint",
    "text_chunk_count": "bigint",
    "table_chunk_count": "bigint",
    "parser": "string",
    "ingestion_version": "string",
    "chunker_version": "string",
    "chunking_version": "string",
    "source_sha256": "string",
    "file_size_bytes": "bigint",
}


def json_type(variant: Column) -> Column:
    """Kind of a variant value: string, integer, float, boolean, array, object; null for null.

    A number with a point is kept by the parser as a decimal, also when its fraction is
    zero; an integer becomes a decimal only beyond 64 bits.
    """
    t = F.schema_of_variant(variant)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.rlike(r"^DECIMAL\((19|[23]\d),0\)"), "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
    )


def records(files: DataFrame) -> DataFrame:
    """Rows whose payload is a JSON object, with it as variant ``v`` in its place."""
    kept = [c for c in files.columns if c != "payload"]
    return files.select(*kept, F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def file_summary(files: DataFrame) -> DataFrame:
    """Per file and field: the type of most non-null values (ties: the first by name), or null."""
    rec = records(files.select("collection", "file_name", "written_at", "payload"))
    each = rec.lateralJoin(rec.sparkSession.tvf.variant_explode(F.col("v").outer()))
    counts = each.groupBy("collection", "file_name", "written_at", F.col("key").alias("field"), json_type(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    # The most frequent kind wins; a null kind (a null value) loses to any.
    order = F.struct(F.col("kind").isNotNull().alias("a"), F.col("n").alias("b"), (-F.ascii(F.col("kind"))).alias("c"), F.col("kind"))
    return counts.groupBy("collection", "file_name", "written_at", "field").agg(F.max(order).alias("o"), F.sum("n").alias("rows")).select(
        "collection", "file_name", "written_at", "field", F.col("o.kind").alias("kind"), "rows"
    )


def in_order(summary: DataFrame) -> DataFrame:
    """The summary with the place ``seq`` of each file in its collection, by written_at, then name."""
    # Rows of one file tie, so that files are numbered without a join.
    return summary.withColumn("seq", F.dense_rank().over(W.partitionBy("collection").orderBy("written_at", "file_name")))


def boundaries(summary: DataFrame) -> DataFrame:
    """What to compare in each file: collection, file_name, wanted (array of seq, side, field).

    ``seq`` is the later file's place; side 0 is a field that vanished before it, side 1 one
    that came with it. Places with one side only need no comparison.
    """
    w = W.partitionBy("collection", "field").orderBy("seq")
    x = summary.where("field is not null").select("collection", "file_name", "field", "seq", F.lead("seq").over(w).alias("next"), F.lag("seq").over(w).alias("before"), F.max("seq").over(W.partitionBy("collection")).alias("last"))
    gone = F.when((F.col("seq") < F.col("last")) & ~F.col("next").eqNullSafe(F.col("seq") + 1), F.struct((F.col("seq") + 1).alias("seq"), F.lit(0).alias("side"), "field"))
    come = F.when((F.col("seq") > 1) & ~F.col("before").eqNullSafe(F.col("seq") - 1), F.struct("seq", F.lit(1).alias("side"), "field"))
    each = x.select("collection", "file_name", F.explode(F.filter(F.array(gone, come), lambda e: e.isNotNull())).alias("e"))
    at = W.partitionBy("collection", "e.seq")
    both = each.withColumn("sides", F.max("e.side").over(at) - F.min("e.side").over(at)).where("sides = 1")
    return both.groupBy("collection", "file_name").agg(F.collect_list("e").alias("wanted"))


def renames(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Vanished and new fields of consecutive files whose values agree for most documents.

    Columns collection, seq (of the later file), old, new, share. A vanished field is
    paired with the new one of the highest agreement, and the reverse. Of a document with
    several records in a file the last to arrive counts.
    """
    rec = records(files.select("row_id", "collection", "file_name", "payload").join(boundaries(summary), ["collection", "file_name"]))
    doc = F.try_variant_get("v", "$.doc_id", "string")
    v = rec.select("collection", "row_id", doc.alias("doc"), F.expr("cast(v as map<string, variant>)").alias("m"), F.explode("wanted").alias("e")).where("doc is not null")
    v = v.select("collection", "row_id", "doc", "e", F.col("m")[F.col("e.field")].alias("x")).where(F.col("x").isNotNull() & ~F.is_variant_null("x"))
    text = F.to_json("x")
    v = v.select("collection", F.col("e.seq").alias("seq"), "doc", F.col("e.side").alias("side"), F.col("e.field").alias("field"), "row_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    one = v.groupBy("collection", "seq", "doc", "side", "field").agg(F.max_by("h1", "row_id").alias("h1"), F.max_by("h2", "row_id").alias("h2"))
    # One value for each field that changed there, so a document's list is as short as its record.
    held = one.groupBy("collection", "seq", "doc").agg(F.collect_list(F.struct("side", "field", "h1", "h2")).alias("all"))
    olds, news = F.filter("all", lambda e: e["side"] == 0), F.filter("all", lambda e: e["side"] == 1)
    pairs = F.flatten(F.transform(olds, lambda o: F.transform(news, lambda n: F.struct(o["field"].alias("old"), n["field"].alias("new"), ((o["h1"] == n["h1"]) & (o["h2"] == n["h2"])).alias("same")))))
    agreed = held.select("collection", "seq", F.explode(pairs).alias("p")).groupBy("collection", "seq", "p.old", "p.new").agg(F.avg(F.col("p.same").cast("double")).alias("share"), F.count("*").alias("n"))
    best = lambda of, other: W.partitionBy("collection", "seq", of).orderBy(F.desc("share"), F.desc("n"), other)
    ranked = agreed.where("share > 0.5").withColumns({"i": F.row_number().over(best("old", "new")), "j": F.row_number().over(best("new", "old"))})
    return ranked.where("i = 1 and j = 1").select("collection", "seq", "old", "new", "share")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Changes and field meanings of one collection, from its files' summaries in order."""
    out: list[tuple] = []
    collection = pdf["collection"].iloc[0]
    known: dict[str, str | None] = {}
    meaning: dict[str, str] = {}
    earlier: set[str] | None = None
    for _, part in sorted(pdf.groupby("seq"), key=lambda x: x[0]):
        name = part["file_name"].iloc[0]
        kinds = {f: (k if isinstance(k, str) else None) for f, k in zip(part["field"], part["kind"]) if isinstance(f, str)}
        moved = {n: o for n, o in zip(part["field"], part["renamed_from"]) if isinstance(o, str) and isinstance(n, str)}
        now = set(kinds)
        if earlier is not None:
            source = set(moved.values())
            out += [(collection, name, "", f, "added") for f in sorted(now - earlier - set(moved))]
            out += [(collection, name, f, "", "removed") for f in sorted(earlier - now - source)]
            out += [(collection, name, o, n, "renamed") for n, o in sorted(moved.items())]
            was, meant = dict(known), dict(meaning)
            for f in earlier - now:
                known.pop(f, None)
                meaning.pop(f, None)
            for n, o in moved.items():
                known[n], meaning[n] = was.get(o), meant.get(o, o)
        for f in sorted(now):
            last = known.get(f)
            if kinds[f] is not None:
                if last is not None and last != kinds[f]:
                    out.append((collection, name, f, f, "type_changed"))
                known[f] = kinds[f]
            meaning.setdefault(f, f)
            out.append((collection, name, f, meaning[f], "means"))
        earlier = now
    return pd.DataFrame(out, columns=["collection", "file_name", "old_field", "new_field", "change"])


def history(files: DataFrame) -> DataFrame:
    """Changes of every collection and, with ``change`` 'means', what each file's fields mean.

    The fold sees a row per file and field, not the records, so a collection that holds a
    third of all rows stays small there.
    """
    summary = durable(in_order(file_summary(files)), "summary")
    moved = renames(files, summary).select("collection", "seq", F.col("new").alias("field"), F.col("old").alias("renamed_from"))
    s = summary.join(moved, ["collection", "seq", "field"], "left")
    schema = "collection string, file_name string, old_field string, new_field string, change string"
    return s.select("collection", "file_name", "seq", "field", "kind", "renamed_from").groupBy("collection").applyInPandas(_fold, schema)


def changes(files: DataFrame) -> DataFrame:
    """file_name, old_field, new_field, change of each file against the previous one.

    Payloads that are null, unreadable or no JSON objects are no records; a file without
    any record has no fields and isn't compared; repeated rows change nothing; the first
    file of a collection changes nothing; an empty table gives no rows. Files of one
    written_at are ordered by name.
    """
    return history(files).where("change <> 'means'").select("file_name", "old_field", "new_field", "change")


def ingest(files: DataFrame, past: DataFrame | None = None, target: Mapping[str, str] = TARGET, approved: Column | None = None) -> DataFrame:
    """One table with a typed column per meaning, and ``_rescued`` with all that doesn't fit.

    A field goes to a target column under its own name, or under a former one where the
    renaming is ``approved`` (a condition over collection, file_name, old_field as the
    name in the file and new_field as its meaning; by default every renaming is). Of an
    object that carries its value under ``value`` that value is taken, so that a field
    that became an object keeps its column. A null value gives null. A value that can't be
    cast without loss, and any unknown field, stays in ``_rescued`` as JSON text; it is
    null where nothing was rescued. Rows that are no records give a row of nulls with the
    payload itself rescued, so that nothing is lost. A line of a file that was delivered again
    counts once, by its latest arrival; rows without a line number all count. No record leaves
    its partition but for the joins with its file's few field meanings and the outdated rows.
    """
    past = history(files) if past is None else past
    means = past.where("change = 'means' and old_field <> new_field")
    if approved is not None:
        means = means.where(approved)
    mapping = means.groupBy("collection", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("old_field", "new_field"))).alias("names"))
    w = W.partitionBy("collection", "file_name", "line_no").orderBy(F.desc("row_id"))
    lines = files.where("line_no is not null").select("row_id", "collection", "file_name", "line_no")
    outdated = lines.withColumn("r", F.row_number().over(w)).where("r > 1").select("row_id")
    v = F.try_parse_json("payload")
    base = files.select("row_id", "collection", "file_name", "written_at", "line_no", "payload").join(outdated, "row_id", "left_anti").withColumn("v", v).join(mapping, ["collection", "file_name"], "left")
    is_record = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    base = base.withColumn("raw", F.when(is_record, F.expr("cast(v as map<string, variant>)")))

    def named(e: Column) -> Column:
        # A record that has both names of one meaning keeps the older name's value rescued.
        meant = F.col("names")[e["key"]]
        return F.struct(F.when(meant.isNull() | F.map_contains_key("raw", meant), e["key"]).otherwise(meant).alias("key"), e["value"].alias("value"))

    base = base.withColumn("m", F.map_from_entries(F.transform(F.map_entries("raw"), named)))
    typed, kept = [], []
    for name, kind in target.items():
        value = F.col("m")[name]
        fits = _fitting(value, kind)
        typed.append(fits.alias(name))
        kept.append(F.when(value.isNotNull() & ~F.is_variant_null(value) & fits.isNull(), F.lit(name)))
    failed = F.filter(F.array(*kept), lambda x: x.isNotNull())
    rest = F.map_filter("m", lambda k, x: (~k.isin(*target) & ~F.is_variant_null(x)) | F.array_contains("failed", k))
    return base.withColumn("failed", failed).select(
        "row_id", "collection", "file_name", "written_at", "line_no", *typed,
        F.when(is_record & (F.size(rest) > 0), F.to_json(rest)).when(~is_record, F.to_json(F.struct(F.col("payload").alias("_unreadable")))).alias("_rescued"),
    )


def _fitting(value: Column, kind: str) -> Column:
    """A variant value in a column's type, or null where it can't be cast without loss."""
    inner = F.coalesce(F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.value", "variant")), value)
    whole = F.schema_of_variant(inner).startswith("OBJECT") | F.schema_of_variant(inner).startswith("ARRAY")
    return F.when(~F.coalesce(whole, F.lit(False)), F.try_variant_get(inner, "$", kind))


def replay(table: DataFrame, approved: Mapping[str, str], target: Mapping[str, str] = TARGET) -> DataFrame:
    """An ingested table after fields were approved later: rescued values go to their columns.

    ``approved`` maps field names to columns of ``target``. A rescued value moves where its
    column is null and takes it without loss; all else stays rescued. The raw files aren't
    read again, and no row moves.
    """
    unknown = sorted(set(approved.values()) - set(target))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    held = F.expr("cast(try_parse_json(_rescued) as map<string, variant>)")
    out = table.withColumn("_held", F.when(F.schema_of_variant(F.try_parse_json("_rescued")).startswith("OBJECT"), held))
    columns, moved = {}, []
    for name, column in approved.items():
        value = _fitting(F.col("_held")[name], target[column])
        free = columns.get(column, F.col(column))
        moved.append(F.when(free.isNull() & value.isNotNull(), F.lit(name)))
        columns[column] = F.coalesce(free, value)
    out = out.withColumns({**columns, "_moved": F.filter(F.array(*moved), lambda x: x.isNotNull())})
    rest = F.map_filter("_held", lambda k, x: ~F.array_contains("_moved", k))
    return out.withColumn("_rescued", F.when(F.size("_moved") == 0, F.col("_rescued")).when(F.size(rest) > 0, F.to_json(rest))).drop("_held", "_moved")
