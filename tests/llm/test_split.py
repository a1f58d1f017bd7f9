"""Problem 6: exact round trip, limits, boundaries."""

import random
import re

from folioscope.llm import split as s


def brute(t, limit):
    parts = [x.strip() for x in re.split(r"\n[^\S\n]*\n", t)]
    if all(len(x) <= limit for x in parts):
        return "paragraph"
    parts = [y for x in parts for y in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", x)]
    if all(len(x) <= limit for x in parts):
        return "sentence"
    return "word" if all(len(x) <= limit for x in t.split()) else "none"


def test_round_trip_and_limits():
    rnd = random.Random(7)
    for _ in range(400):
        t = "".join(rnd.choice(["word ", "a", "長", "。", ". ", "\n", "\n\n", "# H\n", "- item\n", "x" * rnd.randint(1, 70), " ", "😀"]) for _ in range(rnd.randint(1, 250)))
        limit, overlap = rnd.choice([(100, 20), (60, 10), (200, 40)])
        p = s.split(t, limit, overlap, 5)
        assert "".join(t[c:e] for _, c, e in p) == t
        assert all(0 < e - a <= limit for a, _, e in p) or len(t) == 0
        if len(t) > limit:
            assert all(overlap - 5 <= c - a <= overlap + 5 or a - q[0] <= 6 for (a, c, _), q in zip(p[1:], p))
            assert s.boundary(t, limit) == brute(t, limit)


def test_natural_breaks():
    paras = "\n\n".join("Sentence one is here. " * 18 for _ in range(4))
    p = s.split(paras)
    assert s.boundary(paras) == "paragraph" and all(paras[:e].endswith("\n\n") for _, _, e in p[:-1])
    long = "z" * 5000
    assert s.boundary(long) == "none" and len(s.split(long)) == 6
    assert s.split("short") == [(0, 0, 5)] and s.split("") == [(0, 0, 0)]
    huge = "word " * 200_000
    assert sum(e - c for _, c, e in s.split(huge)) == len(huge)


def test_dataframes(spark):
    rows = [("a", "T", 0, None, "x " * 900), ("b", "T", 1, None, "short"), ("c", None, None, None, "one. " * 300), ("d", "T", None, None, None), ("e", "U", 0, None, "")]
    df = spark.createDataFrame(rows, "id string, document_title string, chunk_index int, created_at timestamp_ntz, content string")
    found = {tuple(r) for r in s.split_items(df, "id", "content").select("id", "boundary").collect()}
    assert found == {("a", "word"), ("c", "sentence")}
    out = s.renewed_chunks(df).collect()
    t = sorted((r.chunk_index, r.id) for r in out if r.document_title == "T")
    assert [i for i, _ in t] == list(range(len(t))) and [x for _, x in t][-2:] == ["b", "d"] or [x for _, x in t][-1] in ("b", "d")
    assert {r.chunk_total for r in out if r.document_title == "T"} == {len(t)}
    assert all(r.content is None or len(r.content) <= 1000 for r in out)
    assert s.renewed_chunks(df.limit(0)).count() == 0


def test_found_runs_the_packing(spark, tmp_path):
    from folioscope.llm.registry import QUERIES

    df = spark.createDataFrame([("a", "x " * 900), ("b", "short"), ("c", "one. " * 300), ("d", None), ("e", ("y" * 400 + "\n\n") * 4)], "id string, content string")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    found = QUERIES["p6_found"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", "word"), ("c", "sentence"), ("e", "paragraph")}
    assert "size(pieces" in found._jdf.queryExecution().optimizedPlan().toString()  # rows come from pieces


def test_sections_are_not_mixed():
    """Pieces keep to the heading tree: the last part of A is not joined with B."""
    para = "Some words about it here. " * 14
    t = "".join(f"{h}\n\n{para}\n\n" for h in ("# A", "## A1", "## A2", "# B"))
    cores = [t[c:e] for _, c, e in s.split(t, 1000)]
    assert "".join(cores) == t and len(cores) == 3
    assert [x.count("#") for x in cores] == [3, 2, 1] and cores[1].startswith("## A2") and cores[2].startswith("# B")


def test_nested_lists_and_markup():
    item = "a thing to be done without haste " * 4
    t = "Tasks\n" + "".join(f"- {item}\n" + "".join(f"  - {item}\n" for _ in range(3)) for _ in range(6))
    cores = [t[c:e] for _, c, e in s.split(t, 1000)]
    assert "".join(cores) == t and all(x.startswith(("Tasks", "- ")) for x in cores)  # no item parted from its own
    row = "<tr><td>" + "cell " * 50 + "</td></tr>"
    t = "<div><table>" + row * 4 + "</table></div><div>" + "<p>" + "text " * 60 + "</p></div>"
    cores = [t[c:e] for _, c, e in s.split(t, 1000)]
    assert "".join(cores) == t and any(x.startswith("<div><p>") for x in cores)
    deep = "".join(" " * k + "- x\n" for k in range(3000))
    assert "".join(deep[c:e] for _, c, e in s.split(deep)) == deep


def test_heading_goes_with_its_text():
    t = "# Title\n\n" + "A sentence of some length is here. " * 60
    first = s.split(t)[0]
    assert first[2] > 500 and s.boundary(t) == "sentence"


def test_whole_table(spark, sf):
    """Every chunk of the table: pieces without leads are the text, none is over the limit, and
    numbers run from 0."""
    from folioscope.session import table

    chunks = table(spark, sf, "chunks")
    texts = {r.id: r.content for r in chunks.select("id", "content").collect()}
    got, places, totals = {}, {}, {}
    for r in s.renewed_chunks(chunks).orderBy("document_title", "chunk_index").collect():
        assert r.content is None or len(r.content) <= s.LIMIT
        got[r.id] = got.get(r.id, "") + (r.content[r.lead :] if r.content is not None else "")
        if r.document_title is not None:
            places.setdefault(r.document_title, []).append(r.chunk_index)
            totals.setdefault(r.document_title, set()).add(r.chunk_total)
    assert got == {k: v or "" for k, v in texts.items()}
    assert all(p == list(range(len(p))) and totals[f] == {len(p)} for f, p in places.items())
