"""Rebuild conversations from message rows (problem 5).

Method: sender clock offsets are estimated from reply-before constraints by least squares,
timestamps are corrected, turns are merge-sorted per session, and conversations whose
constraints stay infeasible are rejected.

1. A device's rows come from two clocks: that of the messages and that of the replies.  In a
   session with as many lone messages as lone replies, the i-th reply belongs to the i-th
   message: it must not stand before it nor after the next message.  Each such pair gives a lower
   and an upper bound of the device's offset, the time to add to its replies.
2. A device needs a correction if more of its pairs are broken than chance explains: ``NOISE``
   of pairs may be broken anyhow, and the probability of what is seen (Chernoff's bound) must
   be under ``DOUBT`` over all devices together.  A few broken pairs among many kept are none,
   and neither are distances of reply and message that differ as much as they are long.
3. The offset minimises the squared violations of the device's bounds (Newton steps, one partial
   aggregation each for all devices); it is taken if all but ``NOISE`` of them hold with it.
4. Sessions with a reply that still has no message directly before it are rejected as broken.

Edge cases: repeated rows of one id count once; rows without session are no conversation; rows
without time make their session broken; equal times are ordered by id; null, invisible and
stand-in texts are blank; a session in the list without rows is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blank import is_blank
from ..operators.ordered import HOT_ROWS, any_hot, with_neighbours, with_running_total
from ..session import cut, lookup

#: Share of broken pairs that is no evidence, probability of any wrong correction, Newton steps,
#: and how many standard deviations of its pairs' distances an offset must be.
NOISE, DOUBT, STEPS, CLEAR = 0.05, 0.01, 12, 4


def slim(history: DataFrame, *more: str) -> DataFrame:
    """Each id once, the texts replaced by whether they say anything.  Rows of one id are of one
    session, so the sessions' shuffle is the only one."""
    return history.select(
        "id", "session_id", "device_id", "created_at", (~is_blank(F.col("user_message"))).alias("asks"), (~is_blank(F.col("bot_response"))).alias("answers"), *more
    ).filter("session_id is not null")


def _flags(rows: DataFrame, hot: bool, limit: int) -> DataFrame:
    """Every row of ``rows`` (which have ``at``) with what it breaks; rows without time break
    nothing here."""
    key = ["session_id", "id"]
    rows = rows.dropDuplicates(key) if hot else rows.repartition("session_id").dropDuplicates(key)
    n = with_neighbours(rows, "session_id", "at", "id", ["asks", "answers", "at"], hot, limit)
    timed = lambda side: F.coalesce(F.col(f"{side}.at").isNotNull(), F.lit(False)) & F.col("at").isNotNull()
    asks = lambda side: timed(side) & F.col(f"{side}.asks") & ~F.col(f"{side}.answers")
    message, reply = F.col("asks") & ~F.col("answers"), F.col("answers") & ~F.col("asks")
    before_reply = timed("_next") & F.col("_next.answers") & ~F.col("_next.asks")
    return n.withColumns({"orphan": reply & ~asks("_prev"), "unanswered": message & ~before_reply}).drop("_prev", "_next")


def constraints(rows: DataFrame, hot: bool, limit: int = HOT_ROWS) -> DataFrame:
    """(device_id, lower, upper): bounds in microseconds of the time to add to a device's replies,
    one row for each pair of a lone message and its reply."""
    lone = rows.filter((F.col("asks") != F.col("answers")) & F.col("created_at").isNotNull()).dropDuplicates(["session_id", "id"])
    lone = lone.select("session_id", "id", "device_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.col("answers").cast("long").alias("_reply"))
    lone = with_running_total(lone.withColumn("_message", 1 - F.col("_reply")), "session_id", ["t", "id"], "_reply", "_r", hot, limit)
    lone = with_running_total(lone, "session_id", ["t", "id"], "_message", "_m", hot, limit).filter("_r_all = _m_all")
    is_reply = F.col("_reply") == 1
    none = F.lit(None).cast("long")
    place = lambda rank, m, r, after: F.struct(rank.alias("rank"), m.alias("m"), r.alias("r"), after.alias("after"))
    t = F.col("t")
    own = F.when(is_reply, F.array(place(F.col("_r"), none, t, none))).otherwise(F.array(place(F.col("_m"), t, none, none), place(F.col("_m") - 1, none, none, t)))
    pairs = lone.select("session_id", F.when(is_reply, F.col("device_id")).alias("device_id"), F.inline(own)).groupBy("session_id", "rank").agg(F.max("device_id").alias("device_id"), F.max("m").alias("m"), F.max("r").alias("r"), F.max("after").alias("after"))
    return pairs.filter("m is not null and r is not null and device_id is not null").select("device_id", (F.col("m") - F.col("r")).alias("lower"), (F.col("after") - F.col("r")).alias("upper"))


def _goal(offset: Column) -> Column:
    """The nearest bound that a violated constraint asks for, null if it is kept."""
    return F.when(F.col("lower") > offset, F.col("lower")).when(F.col("upper") <= offset, F.col("upper") - 1)


def clock_offsets(rows: DataFrame, hot: bool, limit: int = HOT_ROWS) -> DataFrame | None:
    """(device_id, shift): microseconds to add to the replies of devices whose clock is off; None
    if no device's is."""
    broken = _goal(F.lit(0)).isNotNull()
    found = cut(constraints(rows, hot, limit))
    by = found.groupBy("device_id").agg(F.count("*").alias("n"), F.count_if(broken).alias("k"), F.abs(F.avg("lower")).alias("mean"), F.stddev_pop("lower").alias("spread"))
    devices = by.agg(F.count("*")).first()[0]
    share = F.col("k") / F.col("n")
    divergence = share * F.log(share / NOISE) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - NOISE))).otherwise(0.0)
    off = cut(by.filter((share > NOISE) & (F.col("mean") >= CLEAR * F.col("spread")) & (F.col("n") * divergence > F.log(F.lit(max(1, devices) / DOUBT)))).select("device_id", "n"))
    if off.isEmpty():
        return None
    own = cut(lookup(found, off.select("device_id"), ["device_id"], "left_semi"))
    shift = off.select("device_id", F.lit(0.0).alias("shift"))
    for _ in range(STEPS):
        # the squared violations of the bounds violated now are least at the mean of the bounds
        goal = lookup(own, shift, ["device_id"], "inner").withColumn("goal", _goal(F.col("shift")))
        moved = cut(goal.groupBy("device_id").agg(F.first("shift").alias("old"), F.avg("goal").alias("goal")).select("device_id", "old", F.coalesce("goal", "old").alias("shift")))
        shift = moved.select("device_id", "shift")
        if moved.filter(F.abs(F.col("shift") - F.col("old")) >= 1).isEmpty():
            break
    shift = cut(shift.select("device_id", F.ceil("shift").cast("long").alias("shift")))
    left = lookup(own, shift, ["device_id"], "inner").groupBy("device_id", "shift").agg(F.count_if(_goal(F.col("shift")).isNotNull()).alias("left"))
    return cut(left.join(off, "device_id").filter((F.col("left") <= NOISE * F.col("n")) & (F.col("shift") != 0)).select("device_id", "shift"))


def corrected(rows: DataFrame, hot: bool, limit: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``at``, the corrected time."""
    offsets = clock_offsets(rows, hot, limit)
    if offsets is None or offsets.isEmpty():
        return rows.withColumn("at", F.col("created_at"))
    shifted = F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("shift")).cast("timestamp_ntz")
    at = F.when(F.col("shift").isNotNull() & F.col("answers") & ~F.col("asks"), shifted).otherwise(F.col("created_at").cast("timestamp_ntz"))
    return lookup(rows, offsets, ["device_id"]).withColumn("at", at).drop("shift")


def rejected(history: DataFrame, sessions: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """(session_id, reason) of the conversations to drop."""
    hot = any_hot(history.select("session_id").filter("session_id is not null"), "session_id", limit)
    f = _flags(corrected(slim(history), hot, limit), hot, limit)
    sums = f.groupBy("session_id").agg(
        F.max(F.col("asks") | F.col("answers")).alias("speaks"),
        F.max(F.col("at").isNull() | F.col("orphan")).alias("broken"),
        (F.min("device_id") != F.max("device_id")).alias("shared"),
        F.max("unanswered").alias("unanswered"),
    )
    known = sessions.select(F.col("id").alias("session_id")).filter("session_id is not null").distinct().withColumn("known", F.lit(True))
    t = known.join(sums, "session_id", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~yes("speaks"), "empty").when(~yes("known") | yes("broken") | yes("shared"), "broken").when(yes("unanswered"), "missing_reply")
    return t.select("session_id", reason.alias("reason")).filter("reason is not null")


def turns(history: DataFrame, sessions: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """(session_id, at, id, turn, role, text) of the conversations kept, ordered by
    (session_id, at, id, turn)."""
    hot = any_hot(history.select("session_id").filter("session_id is not null"), "session_id", limit)
    rows = slim(history.withColumns({"_q": F.col("user_message"), "_a": F.col("bot_response")}), "_q", "_a")
    t = corrected(rows, hot, limit).join(rejected(history, sessions, limit), "session_id", "left_anti").dropDuplicates(["session_id", "id"]).withColumnsRenamed({"_q": "user_message", "_a": "bot_response"})
    both = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.when(F.col("asks"), F.col("user_message")).alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("answers"), F.col("bot_response")).alias("text")))
    return t.select("session_id", "at", "id", F.inline(both)).filter("text is not null").orderBy("session_id", "at", "id", "turn")
