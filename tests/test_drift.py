import json

from datetime import datetime, timedelta

from papyrine.operators import drift

S = "row_id long, collection string, file_name string, written_at timestamp, line_no int, payload string, note string"


def files(spark, spec):
    """spec: (collection, file, day, [payload or dict])."""
    rows, n = [], 0
    for c, f, day, payloads in spec:
        for k, p in enumerate(payloads):
            n += 1
            rows.append((n, c, f, datetime(2024, 1, 1) + timedelta(days=day), k, p if p is None or isinstance(p, str) else json.dumps(p), "x"))
    return spark.createDataFrame(rows, S)


def changes(spark, spec):
    return sorted(tuple(r) for r in drift.changes(files(spark, spec)).collect())


def docs(many, **fields):
    return [{"doc_id": f"d{i}", **{k: (v(i) if callable(v) else v) for k, v in fields.items()}} for i in range(many)]


def test_added_removed_renamed_and_type(spark):
    got = changes(
        spark,
        [
            ("c", "f1", 1, docs(5, count=lambda i: i, gone="x")),
            ("c", "f2", 2, docs(5, n=lambda i: i, new=True)),
            ("c", "f3", 3, docs(5, n=lambda i: str(i), new=None)),
            ("c", "f4", 4, docs(5, n=lambda i: str(i), new=1.0)),
        ],
    )
    assert got == sorted([("f2", "count", "n", "renamed"), ("f2", "gone", "", "removed"), ("f2", "", "new", "added"), ("f3", "n", "n", "type_changed"), ("f4", "new", "new", "type_changed")])


def test_float_is_written_with_a_point_and_nulls_have_no_type(spark):
    got = changes(spark, [("c", "f1", 1, docs(3, a=2)), ("c", "f2", 2, docs(3, a=None)), ("c", "f3", 3, ['{"doc_id": "d0", "a": 2.0}'] * 3)])
    assert got == [("f3", "a", "a", "type_changed")]


def test_what_is_no_record_and_files_delivered_twice_or_late(spark):
    spec = [("c", "f2", 2, docs(3, a=1)), ("c", "f1", 1, [*docs(3, a=1), None, "", "]", "null", "[1]", "3", '{"doc_id": "x"']), ("c", "f2", 2, docs(3, a=1)), ("d", "g1", 1, docs(2, z="q"))]
    assert changes(spark, spec) == []


def test_most_values_decide_on_renaming(spark):
    got = changes(spark, [("c", "f1", 1, docs(5, a=lambda i: i)), ("c", "f2", 2, docs(5, b=lambda i: i if i < 2 else -i))])
    assert got == sorted([("f2", "a", "", "removed"), ("f2", "", "b", "added")])


def test_empty_table(spark):
    assert drift.changes(files(spark, [])) .count() == 0
    assert drift.ingest(files(spark, [])).count() == 0


def test_ingest_keeps_everything(spark):
    spec = [
        ("c", "f1", 1, docs(3, chunk_count=lambda i: str(i + 10), odd={"a": 1})),
        ("c", "f2", 2, [*docs(3, chunks=lambda i: str(i + 10)), {"doc_id": "d9", "chunks": "n/a", "source_sha256": {"algorithm": "x", "value": "ab"}}, "broken {"]),
    ]
    got = {(r.file_name, r.line_no): r for r in drift.ingest(files(spark, spec)).collect()}
    assert got["f1", 0].chunk_count == 10 and json.loads(got["f1", 0]._rescued) == {"odd": {"a": 1}}
    # Renamed by most of the values, cast to the column's type.
    assert got["f2", 2].chunk_count == 12 and got["f2", 2]._rescued is None
    assert got["f2", 3].chunk_count is None and json.loads(got["f2", 3]._rescued) == {"chunk_count": "n/a"} and got["f2", 3].source_sha256 == "ab"
    assert json.loads(got["f2", 4]._rescued) == {"_unreadable": "broken {"}


def test_renaming_that_is_not_approved_stays_rescued(spark):
    from pyspark.sql import functions as F

    spec = [("c", "f1", 1, docs(3, chunk_count=lambda i: i)), ("c", "f2", 2, docs(3, chunks=lambda i: i))]
    got = drift.ingest(files(spark, spec), approved=F.lit(False)).where("file_name = 'f2'").collect()
    assert all(r.chunk_count is None and "chunks" in json.loads(r._rescued) for r in got)


def test_replay_moves_what_was_approved_later(spark):
    from pyspark.sql import functions as F

    spec = [("c", "f1", 1, docs(3, chunk_count=lambda i: i)), ("c", "f2", 2, docs(3, chunks=lambda i: i if i else "n/a", odd=1))]
    held = drift.ingest(files(spark, spec), approved=F.lit(False))
    got = {(r.file_name, r.doc_id): r for r in drift.replay(held, {"chunks": "chunk_count"}).collect()}
    assert got["f2", "d2"].chunk_count == 2 and json.loads(got["f2", "d2"]._rescued) == {"odd": 1}
    assert got["f2", "d0"].chunk_count is None and json.loads(got["f2", "d0"]._rescued) == {"chunks": "n/a", "odd": 1}
    assert got["f1", "d1"].chunk_count == 1 and got["f1", "d1"]._rescued is None


def test_lines_delivered_again_count_once(spark):
    f = files(spark, [("c", "f1", 1, docs(3, parser="a")), ("c", "f1", 1, docs(2, parser="b"))])
    got = sorted((r.doc_id, r.parser) for r in drift.ingest(f).collect())
    assert got == [("d0", "b"), ("d1", "b"), ("d2", "a")]


def test_many_records_of_one_document(spark):
    spec = [("c", "f1", 1, [{"doc_id": "d", "a": i} for i in range(50)] + docs(3, a=lambda i: i)), ("c", "f2", 2, [{"doc_id": "d", "b": i} for i in range(50)] + docs(3, b=lambda i: i))]
    assert changes(spark, spec) == [("f2", "a", "b", "renamed")]
