"""Relations along an order: hot groups give what plain windows give."""

import datetime as dt
import random

from folioscope.operators.ordered import any_hot, with_bucket, with_neighbours, with_running_total


def rows(n=300):
    rnd = random.Random(2)
    t0 = dt.datetime(2025, 1, 1)
    return [(f"i{k:04}", "hot" if rnd.random() < 0.5 else f"s{rnd.randint(0, 20)}", t0 + dt.timedelta(seconds=rnd.randint(0, 5000)), k) for k in range(n)]


def test_neighbours(spark):
    df = spark.createDataFrame(rows(), "id string, s string, t timestamp_ntz, v int").repartition(4)
    a = with_neighbours(df, "s", "t", "id", ["v"], hot=True, limit=50, rows=10)
    b = with_neighbours(df, "s", "t", "id", ["v"], hot=False)
    pick = lambda d: sorted((r.id, r._prev.v if r._prev else None, r._next.v if r._next else None) for r in d.collect())
    assert pick(a) == pick(b)
    assert any_hot(df, "s", 50) and not any_hot(df, "s", 1000)
    assert with_neighbours(df.limit(0), "s", "t", "id", ["v"]).count() == 0


def test_running_total(spark):
    df = spark.createDataFrame(rows(), "id string, s string, t timestamp_ntz, v int")
    order = ["t", "id"]
    a = with_running_total(df, "s", order, "v", "before", True, 50, 10)
    b = with_running_total(df, "s", order, "v", "before", False)
    pick = lambda d: sorted((r.id, r.before, r.before_all) for r in d.collect())
    assert pick(a) == pick(b)


def test_buckets_are_even(spark):
    """One outlying time and many equal times leave no bucket with most of a hot group."""
    t0 = dt.datetime(2025, 1, 1)
    made = [(f"i{k:04}", "hot", t0 if k % 2 else t0 + dt.timedelta(seconds=k), k) for k in range(1000)] + [("last", "hot", t0 + dt.timedelta(days=9000), 0), ("x", "s", t0, 1), ("n", None, t0, 1)]
    df = spark.createDataFrame(made, "id string, s string, t timestamp_ntz, v int")
    b = with_bucket(df, "s", ["t", "id"], 100, 100).groupBy("s", "_bucket").count().collect()
    assert max(r["count"] for r in b) < 300 and sum(r["count"] for r in b) == 1003
    a = with_neighbours(df.filter("s is not null"), "s", "t", "id", ["v"], True, 100, 100)
    c = with_neighbours(df.filter("s is not null"), "s", "t", "id", ["v"], False)
    pick = lambda d: sorted((r.id, r._prev.v if r._prev else None, r._next.v if r._next else None) for r in d.collect())
    assert pick(a) == pick(c)


def test_large_lookup_is_salted(spark):
    from folioscope.session import cut, lookup

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "v int, k string")
    right = cut(spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, n int"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = lookup(left, right, ["k"], how), lookup(left, right, ["k"], how, limit=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
