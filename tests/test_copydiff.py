import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyrine.operators import copydiff as cd

M = "entry_id long, collection string, doc_id string, chunk_count int, text_chunk_count int, table_chunk_count int, source_sha256 string, updated_at timestamp, extra string"
R = "entry_id long, collection string, doc_id string, chunks string, text_chunks string, table_chunks string, source_sha256 string, updated_at timestamp, extra string"


def rows(spark, m, r):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(*x, t, "x") for x in m], M), spark.createDataFrame([(*x, t, "y") for x in r], R)


def run(spark, m, r, **k):
    a, b = rows(spark, m, r)
    return {tuple(x) for x in cd.manifest_registry_differences(a, b, **k).select("collection", "doc_id", "field").collect()}


def test_spellings_blanks_and_nulls_are_equal(spark):
    m = [(1, "c", " A  b ", 7, 7, 0, "AB"), (2, None, "n", None, 1, 1, None), (3, "c", None, 1, 1, 1, "x"), (4, "c", "  ", 1, 1, 1, "x")]
    r = [(1, "c", "a b", "+7", " 007 ", "0.00", " ab\n"), (2, None, "N", " ", "1.0", "1", "  ")]
    assert run(spark, m, r) == set()


def test_each_difference(spark):
    m = [(1, "c", "a", 1, 2, 3, "h"), (2, "c", "only m", 1, 1, 0, "h"), (3, "c", "t", 1, 1, 0, None)]
    r = [(1, "c", "a", "2", "2", "n/a", "g"), (3, "c", "t", "1", "1", "0", "h"), (4, "d", "a", "1", "1", "1", "h")]
    assert run(spark, m, r) == {
        ("c", "a", "chunk_count"), ("c", "a", "table_chunk_count"), ("c", "a", "source_sha256"), ("c", "only m", "missing_in_registry"), ("c", "t", "source_sha256"), ("d", "a", "missing_in_manifest"),
    }


def test_latest_row_counts_and_repeats_do_not(spark):
    m, r = rows(spark, [(1, "c", "a", 1, 1, 0, "h"), (2, "c", "A", 5, 5, 0, "h"), (2, "c", "A", 5, 5, 0, "h")], [(9, "c", "a", "5", "5", "0", "h")])
    m = m.withColumn("updated_at", F.col("updated_at") + F.make_interval(days=F.col("entry_id").cast("int")))
    assert cd.manifest_registry_differences(m, r).count() == 0


@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_empty_tables(spark, side):
    one, two = [(1, "c", "a", 1, 1, 0, "h")], [(1, "c", "a", "1", "1", "0", "h")]
    got = run(spark, [] if side != "right" else one, [] if side != "left" else two)
    assert got == {"left": {("c", "a", "missing_in_manifest")}, "right": {("c", "a", "missing_in_registry")}, "both": set()}[side]


@pytest.mark.parametrize("cells", [4, 96])
def test_against_brute_force_also_where_cells_do_not_suffice(spark, cells):
    rng = random.Random(1)
    m = [(i, f"c{i % 3}", f"d{i}", rng.randint(1, 4), 1, 1, "h") for i in range(900) if rng.random() < 0.9]
    r = [(i, f"c{i % 3}", f"d{i}", str(rng.randint(1, 4)), "1", "1", "h") for i in range(900) if rng.random() < 0.9]
    a, b = {x[1:3]: x[3] for x in m}, {x[1:3]: int(x[3]) for x in r}
    want = {(*k, "missing_in_registry") for k in a.keys() - b.keys()} | {(*k, "missing_in_manifest") for k in b.keys() - a.keys()} | {(*k, "chunk_count") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert run(spark, m, r, cells=cells, keys_per_bucket=64) == want


def test_peeling_reveals_what_was_added():
    import numpy as np

    rng = np.random.default_rng(3)
    e, k = rng.integers(-(2**62), 2**62, 60), rng.integers(-(2**62), 2**62, 60)
    cells: dict = {}
    for n, (x, y) in enumerate(zip(e, k)):
        for p in cd._positions_np(np.array([x]), 64):
            c = cells.setdefault(int(p[0]), [0, 0, 0, 0])
            c[0] += 1 if n % 2 else -1
            c[1] ^= int(x)
            c[2] ^= int(cd._check_np(np.array([x]))[0])
            c[3] ^= int(y)
    pdf = pd.DataFrame([(5, p, *v) for p, v in cells.items()], columns=["bucket", "cell", "n", "e1", "c1", "k1"])
    got = cd.peel(pdf, 64)
    assert not got.failed.any() and sorted(got.k1) == sorted(k.tolist())


def test_failed_buckets_are_peeled_again_with_finer_ones(spark):
    m, r = rows(spark, [], [(i, "c", f"d{i}", "1", "1", "0", "h") for i in range(3000)])
    report = [tuple(x) for x in cd.peeling_report(m, r).collect()]
    assert report[0] == (1, 5, 5) and report[-1][2] == 0
    # Too few cells at any fineness: every row is fetched, and the result is whole.
    few = [tuple(x) for x in cd.peeling_report(m, r, cells=1, keys_per_bucket=3000).collect()]
    assert len(few) == cd.PEELINGS and few[-1][2] > 0
    assert cd.manifest_registry_differences(m, r, cells=1, keys_per_bucket=3000).count() == 3000
