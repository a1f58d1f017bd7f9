"""Shredding against a plain walk, and edge cases."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators.shred import COLUMNS, REPEATED, _parse_deep, assemble, dumps, flat_tables, level_columns, parse, path_of, shred, source_paths, tables, typed, unwrap


def walk(slots, prefix, out):
    for i, o in enumerate(slots):
        if isinstance(o, dict):
            if o:
                out.append(f"{prefix}{i}")
            for n in REPEATED:
                if n in o:
                    v = o[n]
                    walk(v if isinstance(v, list) else [v] if isinstance(v, dict) else [], f"{prefix}{i}/{n}/", out)


def paths(v):
    c = shred(v)
    return sorted(path_of(a, at) for a in tables(c) for at, _ in assemble(c, a))


leaf = st.one_of(st.none(), st.integers(), st.text(max_size=3), st.just({"a": 1}), st.just([1, None]))
obj = st.recursive(
    st.dictionaries(st.sampled_from(["title", "x.y", "a[]", "b?", "c"]), leaf, max_size=3),
    lambda inner: st.builds(lambda d, e: {**d, **e}, st.dictionaries(st.sampled_from(["title", "c"]), leaf, max_size=2), st.dictionaries(st.sampled_from(REPEATED), st.one_of(inner, st.none(), st.lists(st.one_of(st.none(), inner), max_size=3)), max_size=3)),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(st.one_of(obj, st.lists(st.one_of(st.none(), obj), max_size=4)))
def test_paths_equal_a_walk(v):
    want = []
    walk(v if isinstance(v, list) else [v], "", want)
    assert paths(v) == sorted(want)


def test_fields_survive():
    v = [{"title": "t", "passages": [{"score": 1.5, "highlights": [{"start": 1}, None, {"start": 3, "end": None}]}]}]
    c = shred(v)
    rows = {path_of(a, at): r for a in tables(c) for at, r in assemble(c, a)}
    assert rows["0"] == {"title": '"t"'}
    assert rows["0/passages/0"] == {"score": "1.5"}
    assert rows["0/passages/0/highlights/2"] == {"start": "3", "end": "null"}
    assert "0/passages/0/highlights/1" not in rows


def test_wrappers_and_broken_values():
    src = [{"title": "a", "passages": {"score": 1}}]
    for text in (json.dumps(src), json.dumps(json.dumps(src)), json.dumps({"count": 1, "items": src}), json.dumps({"sources": json.dumps(src)}), "﻿ " + json.dumps(src)):
        assert paths(unwrap(parse(text))) == ["0", "0/passages/0"]
    assert paths(unwrap(parse(json.dumps(src[0])))) == ["0", "0/passages/0"]
    for text in (None, "", " ", "null", "[]", "{}", "[{}]", json.dumps(src)[:-3], "[NaN]", '{"items": null}', "3", '"x"', "[" * 100_000):
        v = unwrap(parse(text))
        assert not (isinstance(v, (list, dict)) and paths(v))


def test_deep_and_wide():
    v = {"title": "x"}
    for _ in range(60):
        v = {"title": "x", "related": [v]}
    assert len(paths([v])) == 61
    assert len(paths([{"title": str(i)} for i in range(5000)])) == 5000


def test_dataframes(spark):
    rnd = random.Random(1)
    rows = [("m1", json.dumps([{"title": "a"}, None, {"title": "b", "passages": [{"s": 1}]}]), 1), ("m1", json.dumps([{"title": "a"}, None, {"title": "b", "passages": [{"s": 1}]}]), 1), ("m2", None, 2), ("m3", "oops", rnd.randint(0, 9)), ("m4", '[{"title": "\\ud800"}]', 4)]
    df = spark.createDataFrame(rows, "id string, sources string, path int")
    got = sorted(tuple(r) for r in source_paths(df).collect())
    assert got == [("m1", "0"), ("m1", "2"), ("m1", "2/passages/0"), ("m4", "0")]
    flat = {(r.message_id, r.path): r for r in flat_tables(df.limit(1), "id", "sources").collect()}
    assert flat["m1", "2/passages/0"].parent_path == "2" and flat["m1", "2/passages/0"].kind == "passages"
    assert json.loads(flat["m1", "2"].fields) == {"title": "b"}
    cols = {r.leaf_path: r for r in level_columns(df.limit(1), "id", "sources").collect()}
    assert cols["[].title"].repetition == [0, 1, 1] and cols["[].title"].definition == [3, 1, 3]
    assert source_paths(df.limit(0)).count() == 0


def test_any_depth(spark):
    """Nesting, wrappers and leaf values far beyond the interpreter's stack."""
    n = 3000
    text = '{"title": "x", "related": [' * n + '{"title": "y"}' + "]}" * n
    df = spark.createDataFrame([("m", text), ("cut", text[:-1]), ("leaf", '[{"title": ' + "[" * 40_000 + "]" * 40_000 + "}]")], "id string, sources string")
    got = source_paths(df).groupBy("message_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"m": n + 1, "leaf": 1}
    wrapped = [{"title": "a"}]
    for _ in range(40):
        wrapped = {"data": wrapped} if _ % 2 else json.dumps({"results": wrapped})[:10**6]
        if isinstance(wrapped, str) and len(wrapped) > 10**5:
            break
    assert paths(unwrap(wrapped)) == ["0"]
    deep: list = []
    for _ in range(50_000):
        deep = [deep]
    assert dumps(deep) == "[" * 50_001 + "]" * 50_001 and parse(dumps([{"a\n": 1.5e3, "b": [True, None, "é"]}])) == [{"a\n": 1500.0, "b": [True, None, "é"]}]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(), x, max_size=4)), max_leaves=12), st.integers(0, 200))
def test_deep_parser_equals_the_library(v, k):
    text = json.dumps(v)
    assert _parse_deep(text) == v
    for broken in (text[:k], text + "]", text + ",", "[" + text, text.replace(":", "", 1), text.replace(",", "", 1)):
        try:
            want = json.loads(broken)
        except ValueError:
            want = ValueError
        try:
            got = _parse_deep(broken)
        except ValueError:
            got = ValueError
        assert got == want or got != got


def test_lists_of_any_name(spark):
    v = [{"title": "t", "files": [{"name": "a", "parts": [{"n": 1}, 2]}, None], "tags": ["x"], "passages": {"score": 1}}]
    df = spark.createDataFrame([("m", json.dumps(v))], "id string, sources string")
    got = {(r.path, r.kind): json.loads(r.fields) for r in flat_tables(df, "id", "sources", None).collect()}
    assert got == {("0", "sources"): {"title": "t", "tags": ["x"], "passages": {"score": 1}}, ("0/files/0", "files"): {"name": "a"}, ("0/files/0/parts/0", "parts"): {"n": 1}}


def test_typed(spark):
    v = [{"title": "t", "page": "3", "similarity": "x", "section": {"heading": "h"}}]
    (r,) = typed(flat_tables(spark.createDataFrame([("m", json.dumps(v))], "id string, sources string"), "id", "sources"), "sources", COLUMNS["sources"]).collect()
    assert (r.title, r.page, r.similarity, r.section_heading, r.section_level) == ("t", 3, None, "h", None)
