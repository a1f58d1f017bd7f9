"""Problem 5 on hand-made sessions and against a plain fold."""

import datetime as dt
import random

from folioscope.llm import conversations as c

T0 = dt.datetime(2025, 5, 1)
H = "id string, session_id string, device_id string, user_message string, bot_response string, created_at timestamp_ntz, at int"
S = "id string, device_id string"


def at(n):
    return T0 + dt.timedelta(seconds=n)


def run(spark, rows, sessions, **k):
    h = spark.createDataFrame([(*r, 1) for r in rows], H)
    s = spark.createDataFrame([(x, "d") for x in sessions], S)
    return {tuple(r) for r in c.rejected(h, s, **k).collect()}, h, s


def test_reasons(spark):
    rows = [
        ("1", "ok", "d", "q", "a", at(1)), ("1", "ok", "d", "q", "a", at(1)), ("2", "ok", "d", "q", None, at(3)), ("3", "ok", "d", "...", "a", at(4)),
        ("4", "blank", "d", "N/A", "​", at(1)), ("5", "gone", "d", "q", "a", at(1)), ("6", "timeless", "d", "q", "a", None), ("6b", "timeless", "d", "q", "a", at(1)),
        ("7", "two", "d", "q", "a", at(1)), ("8", "two", "e", "q", "a", at(2)), ("9", "orphan", "d", None, "a", at(1)), ("10", "orphan", "d", "q", "a", at(2)),
        ("11", "late", "d", None, "a", at(1)), ("12", "late", "d", "q", None, at(2)), ("13", "miss", "d", "q", None, at(1)), ("14", "miss", "d", "q", "a", at(2)), ("15", None, "d", "q", None, at(2)),
    ]
    got, h, s = run(spark, rows, ["ok", "blank", "timeless", "two", "orphan", "late", "miss", "norows"])
    assert got == {("blank", "empty"), ("norows", "empty"), ("gone", "broken"), ("timeless", "broken"), ("two", "broken"), ("orphan", "broken"), ("late", "broken"), ("miss", "missing_reply")}
    assert [(r.id, r.role, r.text) for r in c.turns(h, s).collect()] == [("1", "user", "q"), ("1", "assistant", "a"), ("2", "user", "q"), ("3", "assistant", "a")]
    assert c.rejected(h.limit(0), s).count() == 8 and c.rejected(h.limit(0), s.limit(0)).count() == 0


def test_hot_session_and_plain_fold(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        s = "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 60)}"
        q, a = rnd.choice([("q", "a"), ("q", "a"), ("q", "a"), ("q", None), (None, "a"), ("", "-")])
        rows.append((f"m{k:03}", s, "d", q, a, at(rnd.randint(0, 10**6))))
    ids = ["hot", *(f"s{i}" for i in range(61))]
    plain, _, _ = run(spark, rows, ids)
    hot, _, _ = run(spark, rows, ids, limit=30)
    want = set()
    for s in ids:
        own = sorted((r[5], r[0], r[3] == "q", r[4] == "a") for r in rows if r[1] == s)
        if not any(x[2] or x[3] for x in own):
            want.add((s, "empty"))
            continue
        bad = any(x[3] and not x[2] and not (i and own[i - 1][2] and not own[i - 1][3]) for i, x in enumerate(own))
        miss = any(x[2] and not x[3] and not (i + 1 < len(own) and own[i + 1][3] and not own[i + 1][2]) for i, x in enumerate(own))
        if bad or miss:
            want.add((s, "broken" if bad else "missing_reply"))
    assert plain == hot == want


def test_clock_of_a_device(spark):
    """A device whose replies are all stamped early is put right; a single early reply isn't."""
    rows = []
    for k in range(30):
        rows += [(f"q{k:02}", f"s{k}", "skew", "q", None, at(100 * k + 10)), (f"r{k:02}", f"s{k}", "skew", None, "a", at(100 * k + 5))]
    rows += [("x1", "one", "fine", None, "a", at(1)), ("x2", "one", "fine", "q", None, at(2))]
    got, h, s = run(spark, rows, [*(f"s{k}" for k in range(30)), "one"])
    assert got == {("one", "broken")}
    first = c.turns(h, s).filter("session_id = 's3'").collect()
    assert [r.role for r in first] == ["user", "assistant"]


def test_planted_clocks(spark):
    """Among devices with right clocks some are early or late by their own offset, with noise."""
    rnd = random.Random(7)
    rows, right, skewed, n = [], set(), {"early": -7000, "late": 40_000}, 0
    for d in ["early", "late", *(f"d{i}" for i in range(20))]:
        for k in range(25):
            s, t = f"{d}-{k}", rnd.randint(0, 10**6)
            for _ in range(rnd.randint(1, 4)):
                wait, gap = rnd.randint(2, 60), rnd.randint(8000, 20_000)
                rows += [(f"m{n:06}", s, d, "q", None, at(t)), (f"r{n:06}", s, d, None, "a", at(t + wait + skewed.get(d, 0)))]
                n += 1
                t += gap
            if rnd.random() < 0.04 and d not in skewed:  # an orphan, whatever the clock
                rows.append((f"o{n:06}", s, d, None, "a", at(t + 10)))
            else:
                right.add(s)
    sessions = sorted({r[1] for r in rows})
    got, h, s = run(spark, rows, sessions)
    wrong = {x for x, _ in got}
    assert wrong == set(sessions) - right
    found = {r.device_id: r["shift"] / 1e6 for r in c.clock_offsets(c.slim(h), False).collect()}
    assert set(found) == set(skewed) and abs(found["early"] - 7000) < 61 and abs(found["late"] + 40_000) < 20_000
    turns = c.turns(h, s).filter("session_id like 'early%'").collect()
    assert [t.role for t in turns] == ["user", "assistant"] * (len(turns) // 2)
