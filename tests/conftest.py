import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted(str(tuple(fix(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compare a query with its SQL on the same tables."""
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def check(query, sql):
        df, r = query(spark, sf), c.sql(sql)
        assert sorted(df.columns) == sorted(r.columns)
        assert _plain([tuple(x) for x in df.collect()], df.columns) == _plain(r.fetchall(), r.columns)

    return check
