"""Problem 10: ordinal model, disguises, cases."""

import numpy as np
import pytest

from folioscope.llm import severity as sv


@pytest.fixture(scope="module")
def model():
    plain = ["Open the menu and choose a class. The report is saved every evening. Comments stay hidden until you release them."] * 5
    return sv.fit([("none", t) for t in plain])


def test_tokens():
    assert sv.tokens("p0rn V€r$4g€r i d i o t diimwit **bold** раyаsо po​rno") == ["porn", "versager", "idiot", "dimwit", "bold", "payaso", "porno"]
    assert sv.tokens("l*s*r 廢*物") == ["m:lsr", "廢", "物"]
    assert sv.tokens("") == []


def test_thresholds_are_ordered(model):
    assert np.all(np.diff(model.theta, axis=0) >= 0)
    e = model.expected(["I will find out where you live and make you regret that comment.", "you are a complete idiot and everybody in this thread knows it.", "Open the menu."])
    assert e[0, 0] > e[1, 0] > e[2, 0]


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("you ugly fool, learn to read before you post.", "abusive"),
        ("shut up, you w*rthl*ss piece of garbage.", "abusive"),
        ("Southerners are v3rm1n, every last one of them.", "hateful"),
        ("download hot n u d e s of horny couples tonight.", "sexual"),
        ("du bist ein Dummkopf und alle wissen es.", "abusive"),
        ("外國人都是害.蟲，沒有例外。", "hateful"),
    ],
)
def test_cases(model, text, category):
    doc = f"The report is saved every evening.\n{text}\nComments stay hidden."
    got = dict(zip(sv.CATEGORIES, model.document(doc)))
    assert got[category] >= sv.CASE and max(got, key=got.get) == category


@pytest.mark.parametrize("text", ["Words such as moron or loser are blocked by the filter in class chats.", "The history module explains how propaganda described refugees as vermin and why that was wrong.", "The health unit covers breast cancer screening.", "", None, "12 34", "Scores are converted."])
def test_harmless(model, text):
    assert model.document(text).max() < sv.CASE


def test_dataframes(spark, model):
    rows = [(1, "A b", "you damn idiot, you ruined everything again."), (2, "a-b", "All is well."), (3, None, None), (4, "c", "x " * 50_000)]
    s = sv.scores(spark.createDataFrame(rows, "doc_id long, source string, text string"), model)
    assert {tuple(r) for r in sv.cases(s).collect()} == {(1, "abusive")}
    r = {x.source: x for x in sv.rates(s).collect()}
    assert r["a_b"].documents == 2 and r["a_b"].abusive_rate == 0.5 and r[None].documents == 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, "abusive"), (2, "none"), (2, "sexual"), (9, "none")], "doc_id long, label string")
    assert ("abusive", rows[0][2]) in sv.sample(docs, labels) and ("sexual", rows[1][2]) not in sv.sample(docs, labels)
    assert sv.cases(sv.scores(docs.limit(0), model)).count() == 0
