"""Problem 9: counts, shares, caps."""

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing as mx


def test_sources_in_one_spelling(spark):
    df = spark.createDataFrame([(x,) for x in (" Teacher_Guide", "teacher-guide ", "TEACHER GUIDE", "teacher.guide", None, "")], "s string")
    assert [r[0] for r in df.select(mx.clean_source(F.col("s"))).collect()] == ["teacher_guide"] * 4 + [None, ""]


def test_poisson():
    for rate, cap in ((0.3, 1), (1.7, 2), (2.5, 4), (0.05, 3)):
        assert abs(mx.capped_mean(mx.poisson_mean(rate, cap), cap) - rate) < 1e-6
    assert mx.poisson_mean(2, 2) is None


def test_mixture(spark):
    docs = [(i, "ab" if i % 3 else "AB ", "some words of text " * (1 + i % 4)) for i in range(3000)] + [(5000 + i, "tiny", "few words") for i in range(10)] + [(9001, None, "x y"), (9002, "zz", None), (9003, "", "a")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("ab", 0.5, 2), ("tiny", 0.4, 3), ("absent", 0.1, 1)], "source string, target_weight double, max_repeats int")
    assert {r.source for r in mx.short_sources(d, t).collect()} == {"tiny", "absent"}
    m = mx.mixture(d, t).cache()
    assert m.filter("source = 'tiny'").count() == 30 and m.agg(F.max("copy")).first()[0] <= 3
    sizes = mx.sized(d)
    total = sizes.agg(F.sum("tokens")).first()[0]
    used = m.filter("source = 'ab'").agg(F.sum("tokens")).first()[0]
    assert used / total == pytest.approx(0.5, abs=0.03)
    again = mx.mixture(d.repartition(7), t)
    assert [tuple(r) for r in m.collect()] == [tuple(r) for r in again.collect()]  # seeded
    s = {r.source: r for r in mx.shares(d, t).collect()}
    assert s["absent"].copies == 0 and sum(r.share for r in s.values()) == pytest.approx(1)
    assert mx.short_sources(d.limit(0), t).count() == 0 and mx.mixture(d, t.limit(0)).count() == 0


def test_long_texts_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "word " * 100_000), (2, "x" * 250_000), (3, ""), (4, None)], "doc_id long, text string")
    n = {r.doc_id: r.tokens for r in mx.token_counts(df, "text").collect()}
    assert 100_000 <= n[1] <= 100_100 and n[2] > 0 and n[3] == n[4] == 0


def test_written_mixture(spark, tmp_path):
    from folioscope.llm.registry import QUERIES

    docs = [(i, "ab" if i % 3 else "AB ", f"text {i} " * (1 + i % 4)) for i in range(600)] + [(5000 + i, "tiny", f"few {i}") for i in range(10)] + [(9001, None, "x y")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("ab", 0.5, 2), ("tiny", 0.4, 3), ("absent", 0.1, 1)], "source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    QUERIES["p9_mixture"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    d, t = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "mix_targets"))
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((r.doc_id, r.copy) for r in mx.mixture(d, t).collect())
    text = {i: x for i, _, x in docs}
    assert all(r.text == text[r.doc_id] for r in rows) and sum(r.source == "tiny" for r in rows) == 30
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    found = mx.short_sources(d, t)
    assert {r.source for r in found.collect()} == {"tiny", "absent"}
    assert "explode(" in found._jdf.queryExecution().optimizedPlan().toString()  # from the drawn copies
