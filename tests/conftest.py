import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        p = f"{data}/{f}" if os.path.isfile(f"{data}/{f}") else f"{data}/{f}/*.parquet"
        c.sql(f"create view {f.split('.')[0]} as select * from '{p}'")
    return c


def canonical(df):
    """Rows of a pandas frame in a comparable form, whatever the engine's types."""

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            return round(float(v), 6)
        return str(v)

    df = df.astype(object).where(df.notna(), None)
    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)
