"""All found queries on tables with clashing extra columns and all-null rows, and on empty tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folioscope.llm.registry import QUERIES
from folioscope.plans.queries import QUERIES as CORE

ALL = {**CORE, **QUERIES}
FOUND = sorted((n for n in ALL if n.endswith("_found")), key=lambda n: int(n[1:].split("_")[0]))
EXTRA = "file page segments label defect asks answers near grams tokens v h1 own at run piece pieces boundary reason a b key gram w word n rep heads used known item_id item doc text2 first last".split()


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The tables with more columns and a row of nulls; and the tables without any row."""
    more, none = str(tmp_path_factory.mktemp("more")), str(tmp_path_factory.mktemp("none"))
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)
        df = spark.read.parquet(p)
        df.limit(0).write.parquet(f"{none}/{name}")
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        wide = df.unionByName(nulls)
        for i, c in enumerate(c for c in EXTRA if c not in df.columns):
            wide = wide.withColumn(c, F.lit(i) if i % 2 else F.lit("x"))
        wide.repartition(3).write.parquet(f"{more}/{name}")
    return more, none


@pytest.mark.parametrize("name", FOUND)
def test_extra_columns_and_nulls(name, spark, sf, odd):
    want = sorted(tuple(r) for r in ALL[name](spark, sf).collect())
    got = sorted(tuple(r) for r in ALL[name](spark, odd[0]).collect())
    assert got == want


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(name, spark, odd):
    assert ALL[name](spark, odd[1]).count() == 0
