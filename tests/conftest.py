"""One Spark session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ":".join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH", "")]))

import duckdb  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(at / "shared")).config("spark.sql.warehouse.dir", str(at / "warehouse")).config("spark.local.dir", str(at / "local")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def cell(v):
    """A value as text that Spark's and DuckDB's results share."""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result and DuckDB's hold the same rows under the same names."""

    def check(df, con, sql):
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        order = [names.index(c) for c in df.columns]
        assert sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())

    return check
