"""Prompts, replies and ids."""

from pyspark.sql import functions as F

from folioscope.functions.ids import clock, device_id
from folioscope.operators import chat
from folioscope.schema import TABLES


def test_chat(spark):
    rows = [(f"a{i}", f"body {i}", [1.0, 0.0], "Guide", "https://g", "teacher", i, 1, 3, None) for i in range(3)] + [("b0", "other", [0.9, 0.1], "Extra", "", None, 0, 1, 1, None)]
    c = spark.createDataFrame(rows, TABLES["chunks"])
    seen = lambda prompts: [f"reply to {len(p) > 0}" for p in prompts]
    reply, cited = chat.chat(c, "guide body", [1.0, 0.0], seen)
    assert reply.first().reply == "reply to True" and [r.url for r in cited.collect()] == ["https://g"]
    p = chat.prompt("guide body", chat.retrieval.retrieve(c, "guide body", [1.0, 0.0])).first().prompt
    assert p.startswith(chat.INSTRUCTIONS) and "SOURCE: Guide\nURL: https://g" in p and "body 0\nbody 1\nbody 2" in p
    assert p.index("SOURCE: Guide") < p.index("SOURCE: Extra") and p.endswith("Question: guide body")

    def fails(prompts):
        raise OSError("down")

    r = chat.chat(c, "guide", [1.0, 0.0], fails)[0].first()
    assert r.reply == chat.NO_ANSWER and "down" in r.error
    assert chat.chat(c.limit(0), "guide", None, fails)[0].first().reply == chat.NO_ANSWER


def test_requests_and_demo(spark):
    r = spark.createDataFrame([("hi there", ["A", None, "C"]), ("  ", []), (None, []), ("What now", []), ("hello", []), ("x", [])], "message string, titles array<string>")
    ok, refused = chat.routed(r)
    assert ok.count() == 4 and refused.count() == 2
    got = [x[0] for x in r.select(chat.demo_reply(F.col("message"), F.col("titles"))).collect()]
    assert got[0].startswith("Found in A, Unknown.") and got[3].startswith("Good question") and got[4].startswith("Hello") and "'x'" in got[5]


def test_ids(spark):
    row = spark.sql("select timestamp_ntz'2025-01-02 03:04:05' as t").select(device_id(F.lit(1_700_000_000_000), F.lit(35)), clock(F.col("t"))).first()
    assert row[0] == "device_loyw3v28_z" and row[1] == "03:04"
