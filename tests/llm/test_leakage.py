"""Problem 8 against all ten-word windows."""

import random

import numpy as np

from folioscope.llm import leakage as lk


def test_words():
    a = lk.words("Élève’s <b>co-op</b>, it's a [link](http://x.y/z) &amp; **bold** “quote” 第三")
    assert a == ["eleves", "co", "op", "its", "a", "link", "bold", "quote", "第", "三"]
    assert lk.words(None) == lk.words("") == lk.words("...") == []


def test_align():
    x = np.arange(20, dtype=np.int32)
    assert lk.align(x, x) == (40, 20, 20)
    gap = np.concatenate([x[:8], [99], x[8:]]).astype(np.int32)
    score, _, run = lk.align(gap, x)
    assert score == 39 and run == 12
    assert lk.align(np.full(5, -1, np.int32), x)[2] == 0


def test_against_windows(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(30)]
    docs = []
    for k in range(150):
        t = [rnd.choice(vocab) for _ in range(40)]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            n = rnd.randint(7, 14)
            at = rnd.randint(0, 30 - n)
            p = rnd.randint(0, len(t))
            t[p:p] = w[at : at + n]
        docs.append((k, " ".join(x.upper() if rnd.random() < 0.3 else f"**{x}**," for x in t)))
    docs += [(900, None), (901, ""), (902, items[0][1] * 1), (903, " ".join(x for _, x in items) * 20)]
    win = lambda t: {tuple(t[i : i + 10]) for i in range(len(t) - 9)}
    own = {i: win(lk.words(t)) for i, t in items}
    want = {(d, i) for d, t in docs for i in own if t and own[i] & win(lk.words(t))}
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([*items, (77, None), (78, "too short")], "item_id int, text string")
    assert {tuple(r) for r in lk.contained(dd, ii).collect()} == want
    edited = lk.leaks(dd, ii).filter("run >= 10").select("doc_id", "item_id")
    assert {tuple(r) for r in edited.collect()} == want
    assert lk.contained(dd.limit(0), ii).count() == 0 and lk.contained(dd, ii.limit(0)).count() == 0


def test_edited_copies_are_aligned(spark):
    words = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i % 8 == 7 else w for i, w in enumerate(words)]
    other = words[4:9]  # a gram that no window of the copy holds, twice as frequent as the copy's
    ii = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    dd = spark.createDataFrame([(1, "y " * 30 + " ".join(edited) + " z" * 30), (2, "y " * 30), (3, " ".join(other))], "doc_id long, text string")
    got = {r.doc_id: r for r in lk.leaks(dd, ii).collect()}
    # 35 words of 40 kept, 5 replaced, of which the last is outside the alignment
    assert got[1].score == 35 * lk.MATCH + 4 * lk.MISMATCH and got[1].run == 7 and set(got) == {1}
    # a longer run elsewhere does not hide the copy's score
    far = spark.createDataFrame([(4, " ".join(words[:10]) + " y" * 200 + " " + " ".join(edited))], "doc_id long, text string")
    (one,) = lk.leaks(far, ii).collect()
    assert one.run == 10 and one.score == got[1].score
    assert lk.contained(dd, ii).count() == 0 and lk.contained(far, ii).count() == 1


def test_long_copies_are_aligned_whole(spark):
    """300 words of which every fifth is changed, or every fourth after the first forty."""
    words = [f"w{i}" for i in range(300)]
    fifth = [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    fourth = [f"x{i}" if i >= 40 and i % 4 == 3 else w for i, w in enumerate(words)]
    ii = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    dd = spark.createDataFrame([(k, "y " * 70 + " ".join(t) + " z" * 70) for k, t in enumerate((fifth, fourth))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lk.leaks(dd, ii).collect()}
    assert got == {0: 240 * 2 - 59, 1: 235 * 2 - 64}


def test_markup_of_any_length(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    tagged = text.replace("six", f'<a class="{"k " * 400}" href="http://h/{"p" * 900}">six</a>').replace("nine", f"[nine](http://h/{'q' * 2000})")
    assert lk.words(tagged) == text.split()
    ii = spark.createDataFrame([(1, text)], "item_id int, text string")
    dd = spark.createDataFrame([(1, tagged), (2, "x")], "doc_id long, text string")
    assert [tuple(r) for r in lk.contained(dd, ii).collect()] == [(1, 1)]


def test_recall_of_paraphrases(spark):
    """Items of which each word is kept, changed, dropped or followed by another, by chance."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(50))) for i in range(40)]
    docs, want = [], set()
    for k in range(300):
        i, t = rnd.choice(items)
        out = []
        for w in t.split():
            x = rnd.random()
            out += [w] if x < 0.75 else [rnd.choice(vocab)] if x < 0.85 else [] if x < 0.92 else [w, rnd.choice(vocab)]
        docs.append((k, " ".join([rnd.choice(vocab) for _ in range(60)] + out + [rnd.choice(vocab) for _ in range(60)])))
        want.add((k, i))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in lk.leaks(dd, ii).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 3


def test_alignments_of_many_passages():
    rnd = random.Random(1)
    item = np.array([rnd.randint(0, 9) for _ in range(25)])
    docs = [np.array([rnd.randint(0, 9) for _ in range(rnd.randint(1, 60))]) for _ in range(40)]

    def plain(doc):
        h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
        for i, a in enumerate(item):
            for j, b in enumerate(doc):
                h[i + 1][j + 1] = max(0, h[i][j] + (lk.MATCH if a == b else lk.MISMATCH), h[i][j + 1] + lk.GAP, h[i + 1][j] + lk.GAP)
        return max(map(max, h))

    assert lk.align_many(docs, item)[:, 0].tolist() == [plain(d) for d in docs]
