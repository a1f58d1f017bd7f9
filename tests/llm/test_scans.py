"""Problem 2: noise made by hand is found and repaired."""

import random
import re

import pytest

from folioscope.llm import scans

WORDS = "the teacher opens a lesson and every student reads the short text about water before lunch because nothing else works without paper or ink in the morning".split()


def sentence(rnd):
    s = " ".join(rnd.choice(WORDS) for _ in range(9))
    return s[0].upper() + s[1:] + "."


def wrap(text, width=44):
    lines, cur = [], ""
    for w in text.split():
        if len(cur) + len(w) + 1 > width:
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
    return [*lines, cur]


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(4)
    rows, truth = [], set()
    for i in range(120):
        rows.append((f"c{i}", f"clean {i % 10}.pdf", 1, " ".join(sentence(rnd) for _ in range(6)) + " A step-by-step guide is read-only for co-authors."))
    for f in range(6):
        for p in range(1, 9):
            i = f"s{f}-{p}"
            lines = wrap(" ".join(sentence(rnd) for _ in range(5)))
            if p % 3 == 0:
                k = next(n for n, x in enumerate(lines) if "teacher" in x or "student" in x or "because" in x or "without" in x)
                w = next(w for w in ("teacher", "student", "because", "without") if w in lines[k])
                lines[k] = lines[k].replace(w, w[:4] + "-\n" + w[4:], 1)
                truth.add((i, "hyphenation"))
            if p % 4 == 1:
                k, w = next((n, w) for n, x in enumerate(lines) for w in ("lesson", "morning", "student", "teacher", "nothing", "every") if w in x)
                lines[k] = lines[k].replace(w, {"lesson": "le5son", "morning": "rnorning", "student": "sfudent", "teacher": "tcacher", "nothing": "notbing", "every": "evcry"}[w], 1)
                truth.add((i, "misread"))
            if f != 2:
                lines.insert(0, "Handbook | Rubric 17" if p != 2 else "Handb0ok | Rubric 17")
                truth.add((i, "header"))
            if f != 3:
                lines.append(f"      - {p + 4} -" if f % 2 else f"Page {p} of 8")
                truth.add((i, "page_number"))
            rows.append((i, f"scan rubric {f}.pdf", p, "\n".join(lines)))
    df = spark.createDataFrame(rows + [("n", None, None, None), ("e", "x.pdf", 1, ""), ("l", None, 1, "z" * 50_000)], "id string, document_title string, page_number int, content string")
    return df, truth


def test_noise(made):
    df, truth = made
    got = {tuple(r) for r in scans.noises(df).collect()}
    for kind in ("hyphenation", "misread", "header", "page_number"):
        a, b = {x for x in got if x[1] == kind}, {x for x in truth if x[1] == kind}
        assert len(a & b) >= 0.95 * len(b) and len(a - b) <= 0.05 * len(b) + 1, (kind, sorted(b - a)[:5], sorted(a - b)[:5])


def test_paragraphs(made):
    df, _ = made
    rows = scans.paragraphs(df).collect()
    assert len(rows) == 48
    text = " ".join(r.text for r in rows)
    assert not re.search(r"Handb[o0]ok|Page \d|le5son|rnorning|tcacher|notbing|- \d+ -", text)
    assert not re.search(r"[a-z]-\n", text) and "teacher" in text


def test_pieces():
    assert scans.canonical("c1ip") == scans.canonical("clip") and scans.canonical("rnodern") == scans.canonical("modern")
    assert scans.edit_cost("colurnn", "column") == 0.25 and scans.edit_cost("abc", "xyz") >= 3
    e = scans.edges("12\nThe body\ngoes on.\nTitle 4   Page 3 of 9")
    assert e["number_first"] and e["number_last"] and e["last"] == "Title 4"
    assert not scans.edges("75 MB.\nis all")["number_first"]
    e = scans.edges("")
    assert e["first"] is e["last"] is None and not e["number_first"] and not e["number_last"] and e["inner"] == []


def test_empty(made):
    df, _ = made
    assert scans.noises(df.limit(0)).count() == 0


SCHEMA = "id string, document_title string, page_number int, content string"


def pages_of(rnd, name, n, head, width=44):
    return [(f"{name}-{p}", name, p, "\n".join([head, *wrap(" ".join(sentence(rnd) for _ in range(5)), width), f"- {p} -"])) for p in range(1, n + 1)]


@pytest.fixture(scope="module")
def born(spark):
    rnd = random.Random(9)
    return [(f"b{i}", f"born {i % 10}.txt", 1, "\n\n".join(" ".join(sentence(rnd) for _ in range(4)) for _ in range(3))) for i in range(60)]


@pytest.mark.parametrize("name", ["a.pdf", "c.pdf", "d.pdf"])
def test_one_large_file(spark, born, name):
    """Whatever its name, all headers and numbers of a single large file are found."""
    rows = pages_of(random.Random(1), name, 1500, "Yearly report of the board")
    got = scans.noises(spark.createDataFrame(born + rows, SCHEMA)).groupBy("noise").count().collect()
    assert {r["noise"]: r["count"] for r in got} == {"header": 1500, "page_number": 1500}


def test_pages_of_any_kind(spark, born):
    """List pages, wide lines, capitals, Han text and very long running lines of a scanned file."""
    rnd = random.Random(2)
    rows = pages_of(rnd, "lists.pdf", 8, "Handbook of lists")
    rows.append(("list", "lists.pdf", 9, "Handbook of lists\n" + "\n".join(f"- {sentence(rnd)}" for _ in range(12)) + "\n9"))
    wide = "A running line of more than a hundred and fifty characters, as some laws and standards print it on all of their pages, with the full title and the number of the decree"
    rows += pages_of(rnd, "wide.pdf", 5, wide, 160)
    rows += [(i, t, p, c.upper()) for i, t, p, c in pages_of(rnd, "capitals.pdf", 5, "Title of it")]
    han = "老師打開課本學生閱讀關於水的短文因為沒有紙墨什麼都不能用早上大家都在教室裡學習新的單元"
    rows += [(f"han-{p}", "漢.pdf", p, "\n".join(["學生手冊 第七版", *("".join(rnd.choice(han) for _ in range(22)) for _ in range(8)), f"{p}"])) for p in range(1, 6)]
    got = {tuple(r) for r in scans.noises(spark.createDataFrame(born + rows, SCHEMA)).collect()}
    for r in rows:
        assert (r[0], "header") in got and (r[0], "page_number") in got, r[0]
    assert not [x for x in got if x[0].startswith("b")]


def test_every_page_reads_its_header_differently(spark, born):
    rnd = random.Random(3)
    heads = ["Chapter of open wqter", "Chqpter of open water", "Chapter of opxn water", "Chapter of open water"]
    rows = [r for k, h in enumerate(heads) for r in [(f"v{k}", "v.pdf", k, pages_of(rnd, "v.pdf", 1, h)[0][3])]]
    rows += [r for f in range(4) for r in pages_of(rnd, f"o{f}.pdf", 6, f"Other running line {f}")]
    got = {tuple(r) for r in scans.noises(spark.createDataFrame(born + rows, SCHEMA)).collect()}
    assert {f"v{k}" for k in range(4)} <= {i for i, n in got if n == "header"}


def test_continuous(spark, born):
    """Paragraphs that run over page ends come out whole, in order, with nothing lost."""
    rnd = random.Random(5)
    whole = [" ".join(sentence(rnd) for _ in range(rnd.randint(2, 9))) for _ in range(40)]
    lines = [x for p in whole for x in wrap(p)]
    rows = [(f"p{k:02}", "book.pdf", k + 1, "\n".join(["The Book", *lines[k * 9 : k * 9 + 9], str(k + 1)])) for k in range(-(-len(lines) // 9))]
    df = spark.createDataFrame(born + rows, SCHEMA)
    for limit in (10**6, 5):
        got = scans.continuous(df, limit=limit).orderBy("paragraph").collect()
        assert " ".join(r.text for r in got) == " ".join(whole)
        assert len({r.text for r in got} & set(whole)) >= 0.6 * len(whole)  # an end that fills its line looks like no end
    cut = scans.continuous(df, most=2).orderBy("paragraph").collect()
    assert " ".join(r.text for r in cut) == " ".join(whole) and max(r.pages for r in cut) <= 2


def test_paragraphs_over_any_number_of_pages(spark, born):
    """A paragraph on more pages than a stretch, and one of two pages where a stretch ends, are whole."""
    rnd = random.Random(6)
    endless = lambda pages: wrap("So " + " ".join(rnd.choice([w for w in WORDS if len(w) > 1]) for _ in range(pages * 90)), 44)[: pages * 9]
    long, short = endless(150), endless(64)
    rows = [(f"l{k:03}", "long.pdf", k + 1, "\n".join(["Long Book", *long[k * 9 : k * 9 + 9], str(k + 1)])) for k in range(150)]
    rows += [(f"s{k:03}", "short.pdf", k + 1, "\n".join(["Short Book", *(short[k * 9 : k * 9 + 9] if k in (63, 64) else [*wrap(sentence(rnd)), *wrap(sentence(rnd))]), str(k + 1)])) for k in range(66)]
    rows[150 + 64] = (*rows[150 + 64][:3], "\n".join(["Short Book", "and goes on with the paper and the ink of all", "of it.", *wrap(sentence(rnd)), "65"]))
    df = spark.createDataFrame(born + rows, SCHEMA)
    for limit in (10**6, 20):
        got = scans.continuous(df, limit=limit).collect()
        assert [(r.id, r.pages, r.text) for r in got if r.document_title == "long.pdf"] == [("l000", 150, " ".join(long))]
        assert [r.pages for r in got if r.id == "s063" and r.text.endswith("of all of it.")] == [2]
        assert [r.paragraph for r in sorted((r for r in got if r.document_title == "short.pdf"), key=lambda r: r.paragraph)] == list(range(sum(r.document_title == "short.pdf" for r in got)))
