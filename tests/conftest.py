import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Rows of a DuckDB statement over the driver's tables of a scale factor, as sorted text."""
    import duckdb

    def run(sql: str, sf: str = "sf0.001"):
        con = duckdb.connect()
        con.execute("set TimeZone='UTC'")
        for f in os.listdir(f"{DATA}/{sf}"):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{sf}/{f}'")
        got = con.sql(sql)
        order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
        return sorted(got.columns), sorted(tuple(_text(r[i]) for i in order) for r in got.fetchall())

    return run


def _text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def rows():
    def run(df):
        cols = sorted(df.columns)
        return cols, sorted(tuple(_text(r[c]) for c in cols) for r in df.collect())

    return run
