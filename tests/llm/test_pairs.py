"""Problem 7: the field learns, defects are told apart."""

import datetime as dt
import random
import re

import numpy as np
import pytest

from folioscope.llm import crf, language, pairs

ANSWERS = ["Open the menu and choose the class you want to change.", "The file stays in the folder until the end of the week.", "Press the green button below the banner.", "Only teachers may rename a report after it was graded.", "The reminder is sent again two days later.", "Nothing has to be installed because it runs in the browser."]
SPANISH = ["Abra el menú y elija la clase que quiere cambiar.", "El archivo queda en la carpeta hasta el final de la semana.", "Pulse el botón verde debajo del título.", "El recordatorio se envía otra vez dos días más tarde."]
QUESTIONS = ["How do I rename the class?", "Where is the report folder?", "Can students see my file?", "What happens after the deadline?"]


@pytest.fixture(scope="module")
def tagger():
    rnd = random.Random(1)
    rows = [(rnd.choice(QUESTIONS), " ".join(rnd.sample(ANSWERS, 3))) for _ in range(150)] + [("¿Dónde está el informe?", " ".join(rnd.sample(SPANISH, 3))) for _ in range(80)]
    return pairs.fit(rows, language.fit([]))


def test_field_learns_a_chain():
    rnd = random.Random(2)
    data = []
    for _ in range(200):
        tags = ["a"]
        for _ in range(4):
            tags.append("b" if tags[-1] == "a" else rnd.choice("ab"))
        data.append(([["x" if t == "a" or rnd.random() < 0.2 else "y"] for t in tags], tags))
    m = crf.CRF(("a", "b")).fit(data)
    hit = sum(p == t for xs, ts in data for p, t in zip(m.tag(xs), ts))
    assert hit / 1000 >= 0.85


def test_defects(tagger):
    q = QUESTIONS[0]
    full = " ".join(ANSWERS[:3])
    assert tagger.defect(q, full) is None
    assert tagger.defect(q, full[:-30]) == "truncated"
    assert tagger.defect(q, "I'm sorry, but I can't help with that.") == "refusal"
    assert tagger.defect(q, "Thank you for your message. I must decline this request. Please ask your admin.") == "refusal"
    assert tagger.defect(q, q) == tagger.defect(q, q.upper()) == tagger.defect(q, f"> {q}") == "copies_question"
    assert tagger.defect(q, f"{q} {full}") is None
    assert tagger.defect(q, " ".join(SPANISH[:3])) == "other_language"
    assert tagger.defect(q + " Please answer in Spanish.", " ".join(SPANISH[:3])) is None
    assert tagger.defect(q, "Yes.") is None
    assert tagger.defect(q, full + "\n\n```\ncode here") == "truncated"


def test_rows(spark, tagger):
    t = lambda n: dt.datetime(2025, 1, 1, 0, n)
    q, a = QUESTIONS[0], " ".join(ANSWERS[:3])
    rows = [("1", "s", q, None, t(1)), ("2", "s", None, a, t(2)), ("3", "s", q, "", t(3)), ("4", "s", q, a, t(4)), ("5", None, q, "N/A", t(1)), ("6", "s", q, "-", None), ("7", "s", " ", "x", t(9)), ("8", "u", q, None, t(1)), ("8", "u", q, None, t(1)), ("9", "u", q, a[:-20], t(2))]
    h = spark.createDataFrame(rows, "id string, session_id string, user_message string, bot_response string, created_at timestamp_ntz")
    want = {("3", "empty_answer"), ("5", "empty_answer"), ("6", "empty_answer"), ("8", "empty_answer"), ("9", "truncated")}
    assert {tuple(r) for r in pairs.defects(h, tagger).collect()} == want
    assert {tuple(r) for r in pairs.defects(h, tagger, limit=2).collect()} == want
    assert pairs.defects(h.limit(0)).count() == 0


def test_ends_are_counted_over_all_replies(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SAMPLE", 20)
    rnd = random.Random(3)
    replies = [" ".join(rnd.sample(ANSWERS, 3)) for _ in range(300)] + ["Choose the class you want", "Only teachers may rename a", "It is sent two days later"]
    h = spark.createDataFrame([(str(i), QUESTIONS[0], a) for i, a in enumerate(replies)], "id string, user_message string, bot_response string")
    common = pairs.common_words(h.select("bot_response"))
    assert common == pairs.Ends(replies).codes.common
    t = pairs.Tagger(language.fit([]), pairs.Ends(common=common))
    example = t.end_grams(replies[0][:-1])
    whole = pairs.Ends(replies, common).counts
    ends, counts = pairs.end_counts(h, t, set(example))
    assert counts == {g: whole[g] for g in example}
    got = {r.key: {x.g: (x.f, x.k) for x in r.grams} for r in ends.collect()}
    assert got == {g[-1]: {x: whole[x] for x in g} for a in replies[-3:] if (g := t.end_grams(a))} and len(got) == 3
    last = got[t.end_grams(replies[-1])[-1]][t.end_grams(replies[-1])[0]]
    assert last == (sum(a.count("later.") for a in replies), sum(a.count("later") for a in replies))


def test_clauses_and_messages_are_scored_once(tagger, monkeypatch):
    """What comes again costs no second scoring, and changes nothing, however much is kept."""
    rnd = random.Random(8)
    pool = [*ANSWERS, *SPANISH, *QUESTIONS, "I can't help with that.", "Thank you for your message.", "Press the green", "* the menu", "```\nx\n```", "(", "12", "🙂"]
    rows = [(rnd.choice([*QUESTIONS, "¿Dónde está el informe?", "?!"]), rnd.choice([" ", "\n"]).join(rnd.choices(pool, k=rnd.randint(1, 5)))) for _ in range(300)]
    want = [(tagger.crf.tag(xs), sizes) if (xs := (f := tagger.features(*r))[0]) and (sizes := f[1]) else ([], []) for r in rows]
    for kept, chars in ((40_000, 400), (3, 400), (40_000, -1)):
        monkeypatch.setattr(tagger, "KEPT", kept, raising=False)
        monkeypatch.setattr(tagger, "KEPT_CHARS", chars, raising=False)
        tagger.forget()
        assert [tagger.tags(*r) for r in rows] == want
    monkeypatch.undo()
    scored = []
    scores = tagger.lid.scores
    monkeypatch.setattr(tagger.lid, "scores", lambda parts: scores([scored.append(p) or p for p in parts]))
    tagger.forget()
    for r in rows[:50] * 2:
        tagger.defect(*r)
    clauses = {c for _, a in rows[:50] for c in tagger.clauses(a)[0] if language._TOKEN.search(c.lower())}
    asked = [p for q in {q for q, _ in rows[:50]} for p in language.fragments(q)]
    assert sorted(scored) == sorted([*clauses, *asked])


def test_repeated_clauses_count_as_often_as_they_stand():
    once = pairs.Ends(["Press the green button. It stays", "It stays"], {"press", "it"})
    more = pairs.Ends(["Press the green button. It stays", "It stays"] * 7 + ["It stays"], {"press", "it"})
    own = set(more.grams("It stays"))
    assert more.counts == {g: (7 * f, 7 * k + (g in own)) if g in own else (7 * f, 7 * k + (g == more.grams("It")[0])) for g, (f, k) in once.counts.items()}


def test_pairs_are_tagged_together(tagger, monkeypatch):
    """Pairs of which no clause comes again cost no scoring of their own, and have the defects they
    have one by one, by the field on their features."""
    rnd = random.Random(9)
    ends = [".", "", " and", "\n```\nx", " (see", ",", "。", "\n* a\n* b"]
    rows = [(rnd.choice([*QUESTIONS, "?!", "¿Dónde está el informe?"]), " ".join(f"{s[:-1]} {i}x{j}." for j, s in enumerate(rnd.sample([*ANSWERS, *SPANISH], rnd.randint(0, 4)))) + rnd.choice([*QUESTIONS, *ANSWERS, "I can't help with that."])[: rnd.randint(5, 60)] + rnd.choice(ends)) for i in range(300)]
    rows += [(q, q) for q in QUESTIONS] + [(QUESTIONS[0], ">"), ("x", "I can't help with that."), ("x", " ".join(SPANISH))]
    tagger.forget()
    want = [tagger.defect(*r) for r in rows]
    assert len(set(want)) == 5
    for r in rows:
        xs, sizes = tagger.features(*r)
        assert tagger.tags(*r) == (tagger.crf.tag(xs) if xs else [], sizes)
    calls, scores = [], tagger.lid.scores
    monkeypatch.setattr(tagger.lid, "scores", lambda parts: calls.append(1) or scores(parts))
    tagger.forget()
    assert tagger.defects([(q, *tagger.clauses(a)) for q, a in rows]) == want
    assert len(calls) == 2  # the clauses, and the messages


def test_paths_of_many_chains():
    rnd = np.random.default_rng(4)
    m = crf.CRF("abcd")
    m.moves, m.first = rnd.normal(size=(4, 4)), rnd.normal(size=4)
    sizes = rnd.integers(1, 9, 200)
    e = rnd.integers(-2, 3, (sizes.sum(), 4)).astype(float)
    parts = np.split(e, np.cumsum(sizes)[:-1])
    assert ["abcd"[k] for k in m.best_of(e, sizes)] == [t for x in parts for t in m.best(x.tolist())]


def test_clauses_end_where_they_did():
    old = re.compile(r"(?<=[.!?。！？])[)\"'»”’」]*\s+|(?<=[。！？])(?=[^\s」』”）)])|[\r\n]+")
    rnd = random.Random(5)
    for _ in range(20_000):
        s = "".join(rnd.choices(".!?。！？…)\"'»”’」』）]_\r\n \t\x85ab1中❶🙂☀", k=rnd.randint(0, 12)))
        assert pairs._split(s) == old.split(s)
        assert all(pairs._ended(c) == bool(pairs._END.search(c)) for c in (s, *pairs._split(s)))


def test_steps_take_every_row_once(monkeypatch):
    monkeypatch.setattr(pairs, "STEP", 10)
    for texts in ([], [None], ["x" * 30], ["x", None, "yyyy", "z" * 9, "", "w" * 20, "v"]):
        steps = [*pairs._steps(texts, texts)]
        assert [i for s in steps for i in s] == [*range(len(texts))]
    assert len(steps) == 4
