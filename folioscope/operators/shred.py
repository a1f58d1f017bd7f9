"""Columnar shredding of nested records into flat tables.

A record is a list of objects whose members may hold further lists of objects.  Shredding
stores one column per *leaf path* (``passages[].highlights[].term``), each a sequence of
``(repetition level, definition level, value)``:

* repetition level: how many of the path's list steps go on within the same list element;
  0 starts the record.
* definition level: every list step adds two levels (the list has a slot here; the slot holds
  an object) and the leaf adds one.  A lower level says which ancestor is absent.

Every leaf column therefore knows all slots of its ancestors, and the table of a repeated
ancestor is rebuilt from the levels of any column below it.  A list step also has a column of
its own (``passages[]``), which carries objects and slots without any leaf.  Nothing is
shuffled: a record's columns are made and read where the record lies.

Rows and edge cases: ``null`` elements keep their position and give no row; an object where a
list is expected is element 0; an object without members gives no row; text that is not one
complete JSON value gives nothing; null or blank input gives nothing; repeated rows of one id
are taken once by the queries, not here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Members that hold lists of objects.
REPEATED = ("passages", "highlights", "related")
#: Members that mark an object as a source rather than as a wrapper around sources.
OWN_MEMBERS = frozenset(("title", "url", "similarity", "section", "passages", "related", "chunk_index", "score", "start", "end"))

#: Names under which wrappers keep the sources.
WRAPPERS = frozenset(("sources", "items", "results", "data", "documents"))

Levels = tuple[list[int], list[int], list[str | None]]


def _constant(name: str):
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _parse_deep(text: str):
    """The JSON value of a text nested deeper than the parser goes, with a stack of its own."""
    stack: list = []  # (container, name of the member that is being read)
    at, value, state = 0, None, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(at)
        at, mark = m.end(), m[1]
        if state in ("value", "first") and mark in ("[", "{"):
            stack.append([[] if mark == "[" else {}, None])
            state = "first" if mark == "[" else "name?"
            continue
        if state == "value" and mark is None or state == "first" and mark is None:
            value = json.loads(m[2] or m[3], parse_constant=_constant)
        elif state == "first" and mark == "]" or state == "next" and stack and mark == ("]" if isinstance(stack[-1][0], list) else "}") or state == "name?" and mark == "}":
            value = stack.pop()[0]
        elif state in ("name", "name?") and m[2]:
            stack[-1][1] = json.loads(m[2])
            state = "colon"
            continue
        elif state == "colon" and mark == ":":
            state = "value"
            continue
        elif state == "next" and mark == ",":
            state = "value" if isinstance(stack[-1][0], list) else "name"
            continue
        else:
            raise ValueError(at)
        if not stack:
            if text[at:].strip(" \t\r\n"):
                raise ValueError(at)
            return value
        inside, name = stack[-1]
        if isinstance(inside, list):
            inside.append(value)
        else:
            inside[name] = value
        state = "next"


def parse(text: str | None):
    """The JSON value of ``text``, however deep; None where it isn't one complete value."""
    if not text:
        return None
    text = text.strip("﻿ \t\r\n")
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        try:
            return _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def dumps(value) -> str:
    """The JSON text of ``value``, however deep."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out: list[str] = []
        todo: list = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, _Text):
                out.append(x)
            elif isinstance(x, list):
                inner = [y for v in x for y in (_Text(", "), v)][1:]
                todo += [_Text("]"), *reversed(inner), _Text("[")]
            elif isinstance(x, dict):
                inner = [y for k, v in x.items() for y in (_Text(", "), _Text(json.dumps(k, ensure_ascii=False) + ": "), v)][1:]
                todo += [_Text("}"), *reversed(inner), _Text("{")]
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


class _Text(str):
    """Text that is put out as it is."""


def unwrap(value, own: frozenset[str] = OWN_MEMBERS):
    """The list of sources inside outer strings and objects that only wrap it, however many."""
    while True:
        if isinstance(value, str):
            value = parse(value)
        elif isinstance(value, dict) and not own & value.keys():
            inner = [x for x in value.values() if isinstance(x, (list, dict))] or [x for x in value.values() if isinstance(x, str) and x.lstrip()[:1] in ("[", "{")]
            if not inner:
                return [] if WRAPPERS & value.keys() else value
            value = inner[0]
        else:
            return value


def _slots(value) -> list:
    """The elements of a list position; an object stands for a list of one."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _part(name: str) -> str:
    """A member's name as one step of a path."""
    return name.replace("%", "%25").replace(".", "%2E").replace("[", "%5B").replace("?", "%3F")


class Step:
    """A list step of a record's schema: its own levels, those of its leaves, and the steps below."""

    __slots__ = ("name", "above", "depth", "own", "leaves", "below")

    def __init__(self, name: str | None = None, above: Step | None = None):
        self.name, self.above, self.depth = name, above, above.depth + 1 if above else 1
        self.own: Levels = ([], [], [])
        self.leaves: dict[tuple[str, bool], Levels] = {}  # (name, whether it is a list below)
        self.below: dict[str, Step] = {}

    def steps(self) -> Iterator[Step]:
        """This step and all below it, outermost first."""
        todo = [self]
        while todo:
            s = todo.pop()
            yield s
            todo += reversed(s.below.values())

    def names(self) -> list[str]:
        out: list[str] = []
        s = self
        while s.above:
            out.append(s.name)
            s = s.above
        return out[::-1]

    def path(self) -> str:
        return ".".join(["[]", *(f"{_part(n)}[]" for n in self.names())])


def _is_repeated(name: str, value, repeated: frozenset[str] | None) -> bool:
    """Whether a member is a list step: by its name, or, without names, if it holds objects."""
    return name in repeated if repeated is not None else isinstance(value, list) and any(isinstance(x, dict) for x in value)


def _schema(slots: list, repeated: frozenset[str] | None) -> Step:
    root = Step()
    todo = [(slots, root)]
    while todo:
        own, step = todo.pop()
        for obj in own:
            if isinstance(obj, dict):
                for name, x in obj.items():
                    if _is_repeated(name, x, repeated):
                        step.leaves.setdefault((name, True), ([], [], []))
                        if inner := _slots(x):
                            if name not in step.below:
                                step.below[name] = Step(name, step)
                            todo.append((inner, step.below[name]))
                    else:
                        step.leaves.setdefault((name, False), ([], [], []))
    return root


def _put(levels: Levels, r: int, d: int, v: str | None) -> None:
    levels[0].append(r)
    levels[1].append(d)
    levels[2].append(v)


def shredded(value, repeated: frozenset[str] | None = frozenset(REPEATED), values: bool = True) -> Step:
    """The schema of one record with the levels and values of all its columns.  ``repeated`` names
    the members that hold lists of objects; None takes every list that holds an object."""
    top = _slots(value)
    root = _schema(top, repeated)
    todo: list[tuple[Step, object, int, int]] = []  # (step, slot, repetition level, kind of slot)

    def push(slots: list, step: Step, r: int) -> None:
        if not slots:
            todo.append((step, None, r, 2 * (step.depth - 1)))
        for k in range(len(slots) - 1, -1, -1):
            todo.append((step, slots[k], step.depth if k else r, 2 * (step.depth - 1) + 1))

    push(top, root, 0)
    while todo:
        step, obj, r, d = todo.pop()
        if not isinstance(obj, dict):
            for s in step.steps():
                _put(s.own, r, d, None)
                for levels in s.leaves.values():
                    _put(levels, r, d, None)
            continue
        full = 2 * step.depth
        _put(step.own, r, full, None)
        for (name, listed), levels in step.leaves.items():
            there = name in obj and _is_repeated(name, obj[name], repeated) == listed
            _put(levels, r, full + there, dumps(obj[name]) if there and values and not listed else None)
        for name, inner in reversed(step.below.items()):
            x = obj.get(name)
            push(_slots(x) if _is_repeated(name, x, repeated) else [], inner, r)
    return root


def _columns(root: Step) -> Iterator[tuple[str, Levels]]:
    """(leaf path, levels) of all columns."""
    for s in root.steps():
        path = s.path()
        yield path, s.own
        for (name, listed), levels in s.leaves.items():
            yield f"{path}.{_part(name)}{'?' if listed else ''}", levels


def shred(value, repeated: frozenset[str] | None = frozenset(REPEATED), values: bool = True) -> dict[str, Levels]:
    """Leaf path to (repetition levels, definition levels, values) of one record.

    The root list is the step ``[]``.  Values are JSON texts; with ``values`` false only the
    levels are kept.
    """
    return dict(_columns(shredded(value, repeated, values)))


def _rows(depth: int, own: Iterator[tuple[str, bool, Levels]]) -> list[tuple[tuple[int, ...], dict[str, str | None]]]:
    full = 2 * depth
    rows: dict[tuple[int, ...], dict[str, str | None]] = {}
    for name, listed, (rs, ds, vs) in own:
        at = [-1] * depth
        for r, d, v in zip(rs, ds, vs):
            step = r - 1 if r else 0  # the list that goes on; 0 starts the record
            at[step] += 1
            at[step + 1 :] = [0] * (depth - step - 1)
            if d > full:
                row = rows.setdefault(tuple(at), {})
                if not listed:
                    row[name] = v
    return sorted(rows.items())


def assemble_step(step: Step) -> list[tuple[tuple[int, ...], dict[str, str | None]]]:
    """Rows of the table of a list step: the positions along the steps and its own leaf values,
    rebuilt from the level sequences alone."""
    return _rows(step.depth, ((name, listed, levels) for (name, listed), levels in step.leaves.items()))


def assemble(columns: dict[str, Levels], ancestor: str) -> Iterator[tuple[tuple[int, ...], dict[str, str | None]]]:
    """``assemble_step`` on columns by path."""
    cut = len(ancestor) + 1
    own = ((p[cut:].rstrip("?"), p.endswith("?"), c) for p, c in columns.items() if p.startswith(ancestor + ".") and "." not in p[cut:] and not p.endswith("[]"))
    yield from _rows(ancestor.count("[]"), own)


def tables(columns: dict[str, Levels]) -> list[str]:
    """The repeated ancestors of a record, outermost first."""
    return sorted((p for p in columns if p.endswith("[]")), key=lambda p: (p.count("[]"), p))


def steps(ancestor: str) -> list[str]:
    """The list names below the root: ``[].related[].passages[]`` has related, passages."""
    return [x[:-2] for x in ancestor.split(".")[1:]]


def _place(names: list[str], at: tuple[int, ...]) -> str:
    return "/".join([str(at[0]), *(f"{n}/{i}" for n, i in zip(names, at[1:]))])


def path_of(ancestor: str, at: tuple[int, ...]) -> str:
    return _place(steps(ancestor), at)


def _clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode("utf-8")


_TABLE = T.StructType([T.StructField(n, T.StringType()) for n in ("message_id", "path", "parent_path", "kind", "fields")])
_COLUMNS = T.StructType(
    [T.StructField("message_id", T.StringType()), T.StructField("leaf_path", T.StringType()), T.StructField("repetition", T.ArrayType(T.IntegerType())), T.StructField("definition", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.StringType()))]
)


def _named(repeated: tuple[str, ...] | None) -> frozenset[str] | None:
    return None if repeated is None else frozenset(repeated)


def level_columns(df: DataFrame, id_col: str, json_col: str, repeated: tuple[str, ...] | None = REPEATED) -> DataFrame:
    """One row per record and leaf path with its level sequences and values."""
    names = _named(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for path, (r, d, v) in shred(unwrap(parse(text)), names).items():
                    for o, x in zip(out, (key, _clean(path), r, d, [None if y is None else _clean(y) for y in v])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), *(pa.array(x, pa.list_(pa.int32())) for x in out[2:4]), pa.array(out[4], pa.list_(pa.string()))], names=[f.name for f in _COLUMNS])

    return df.select(F.col(id_col).cast("string"), F.col(json_col)).filter(F.col(json_col).isNotNull()).mapInArrow(run, _COLUMNS)


def flat_tables(df: DataFrame, id_col: str, json_col: str, repeated: tuple[str, ...] | None = REPEATED, fields: bool = True) -> DataFrame:
    """All child tables as one relation (message_id, path, parent_path, kind, fields).

    ``kind`` names the list a row stood in (``sources`` for the outermost), ``fields`` is the
    JSON object of its own leaves.  Filter by ``kind`` for one table; join
    (message_id, parent_path) to (message_id, path) for its parent.  With ``repeated`` None every
    list that holds an object is a table, whatever its name.
    """
    names = _named(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = unwrap(parse(text))
                if not _slots(value):
                    continue
                for step in shredded(value, names, fields).steps():
                    kind, path_names = step.name or "sources", step.names()
                    for at, row in assemble_step(step):
                        path = _clean(_place(path_names, at))
                        parent = _clean(_place(path_names[:-1], at[:-1])) if path_names else None
                        body = _clean("{" + ", ".join(f"{json.dumps(k)}: {v}" for k, v in sorted(row.items())) + "}") if fields else None
                        for o, x in zip(out, (key, path, parent, _clean(kind), body)):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=[f.name for f in _TABLE])

    return df.select(F.col(id_col).cast("string"), F.col(json_col)).filter(F.col(json_col).isNotNull()).mapInArrow(run, _TABLE)


def source_tables(history: DataFrame) -> DataFrame:
    """The flat tables of ``chat_history.sources``, each message id taken once."""
    return flat_tables(_once(history), "id", "sources")


def typed(rows: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """The table of one ``kind`` with typed columns: ``columns`` maps ``name`` or
    ``member.name`` of an inner object to a SQL type; values of another type are null."""
    own = rows.filter(F.col("kind") == kind)
    value = lambda n: F.get_json_object("fields", "$" + "".join(f"['{p}']" for p in n.split(".")))
    return own.select("message_id", "path", "parent_path", *(value(n).try_cast(t).alias(n.replace(".", "_")) for n, t in columns.items()))


#: Columns of the tables of ``chat_history.sources``.
SOURCE = {"title": "string", "url": "string", "type": "string", "page": "bigint", "similarity": "double", "section.heading": "string", "section.level": "bigint"}
COLUMNS = {"sources": SOURCE, "related": SOURCE, "passages": {"chunk_index": "bigint", "score": "double"}, "highlights": {"start": "bigint", "end": "bigint", "term": "string"}}


def _once(history: DataFrame) -> DataFrame:
    """One row of each id; repeated rows hold the same values, so any of them will do."""
    return history.select("id", "sources").filter("sources is not null").groupBy("id").agg(F.first("sources").alias("sources"))


def source_paths(history: DataFrame) -> DataFrame:
    """(message_id, path) of every object in the arrays of sources.

    The records are shredded before repeated rows are merged: the short paths are shuffled,
    not the JSON.
    """
    return flat_tables(history, "id", "sources", fields=False).select("message_id", "path").distinct()
