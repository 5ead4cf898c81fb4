import glob
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0  # NaN equals nothing, so it fails: queries and SQL must agree on what it counts as
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def assert_same(df, sql: str, sf_dir: str):
    """Rows of the Spark query and of the SQL are equal, columns matched by name."""
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in rows), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
