"""Split oversized items at natural boundaries (problem 6).

Method: structure-tree packing.  A text is parsed into a tree of spans: sections by headings,
nested by their levels; blocks between blank lines; inside a block headings, list items nested
by indentation, markup elements nested by their tags, and lines; then sentences, words and
code points.  Only nodes over the limit are opened.  What an opened node holds is packed
bottom-up: neighbouring siblings are merged while they fit, and the pieces of an oversized node
are never merged with its parent's other children, so no piece joins parts of two sections.  A
heading goes with the first piece after it.  Sentences and words aren't structure: the rest of a
long one is filled up with the next.  Each piece after the first is led by about ``overlap`` code
points of the text before it, begun at a sentence or word if there is one near.

``boundary`` is read off the tree: ``paragraph`` if no block is over the limit, ``sentence`` if
no sentence of such blocks is (over their lines), ``word`` if no word of theirs is, else ``none``.  Pieces without their lead concatenate to the text exactly.

Edge cases: null texts and texts up to the limit are not split; lengths count code points;
texts of any length take time in proportion, as nesting is at most some forty levels deep;
repeated rows are split alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import any_hot, with_running_total

LIMIT, OVERLAP, SLACK = 1000, 100, 20

_BLANK = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
_HEADING = re.compile(r"[^\S\r\n]*(?:(#{1,6})\s|<h([1-6])\b|(=+)\s|(\d+(?:\.\d+)*)\.?[^\S\r\n]+[^\W\d_a-z]\S*(?: \S+){0,6}[^\S\r\n]*(?:[\r\n]|$))")
_LINE = re.compile(r"\r\n|\r|\n|(?=</?(?:p|li|ul|ol|tr|table|div|section|article|br)\b)")
_TAG = re.compile(r"[^\S\r\n]*<(/?)(p|li|ul|ol|tr|table|div|section|article|br)\b")
_ITEM = re.compile(r"([^\S\r\n]*)(?:[-*+•·]|\d+[.)]|[a-zA-Z][)])\s")
_SENTENCE = re.compile(r"[.!?](?=\s)\s*|[。！？]\s*")
_WORD = re.compile(r"\s+")
#: Deepest nesting of items and of tags that makes a difference.
_DEEP = 16
_NEST = frozenset(("ul", "ol", "table", "div", "section", "article", "li", "tr"))


class Node:
    """A span of the text; ``kind`` is section, block, part, sentence, word or none."""

    __slots__ = ("lo", "hi", "kind", "rank", "kids", "heading")

    def __init__(self, lo: int, hi: int, kind: str, rank: float = 0, heading: bool = False):
        self.lo, self.hi, self.kind, self.rank, self.heading = lo, hi, kind, rank, heading
        self.kids: list[Node] = []


def _ends(text: str, lo: int, hi: int, cut: re.Pattern) -> Iterator[int]:
    """Ends of the children of a span: separators stay with what they end."""
    for m in cut.finditer(text, lo, hi):
        if lo < m.end() < hi:
            yield m.end()
    yield hi


def _spans(text: str, lo: int, hi: int, cut: re.Pattern) -> Iterator[tuple[int, int]]:
    for end in _ends(text, lo, hi, cut):
        if end > lo:
            yield lo, end
            lo = end


def _heading(text: str, lo: int, hi: int) -> int:
    """The level of the heading a span begins with, 0 if it begins with none."""
    m = _HEADING.match(text, lo, hi)
    if not m:
        return 0
    return min(6, len(m[1] or m[3] or "") or int(m[2] or 0) or m[4].count(".") + 1)


def _nest(root: Node, nodes: Iterator[tuple[Node, Node]]) -> Node:
    """Hang every (outer, inner) node under the last one of a lower rank; ``outer`` spans what
    hangs below it, ``inner`` is its own text."""
    stack = [root]
    for outer, inner in nodes:
        while len(stack) > 1 and stack[-1].rank >= outer.rank:
            stack.pop()
        stack[-1].kids.append(outer)
        if outer is not inner:
            outer.kids.append(inner)
            stack.append(outer)
        for above in stack:
            above.hi = max(above.hi, inner.hi)
    return root


def tree(text: str) -> Node:
    """The sections and blocks of ``text``; blocks are opened by ``children``."""

    def nodes() -> Iterator[tuple[Node, Node]]:
        for lo, hi in _spans(text, 0, len(text), _BLANK):
            level = _heading(text, lo, hi)
            block = Node(lo, hi, "block", 99, level > 0)
            yield (Node(lo, hi, "section", level), block) if level else (block, block)

    return _nest(Node(0, len(text), "section", -1), nodes())


def _parts(text: str, node: Node) -> list[Node]:
    """The headings, items, elements and lines of a block, nested."""

    def nodes() -> Iterator[tuple[Node, Node]]:
        depth = 0
        for lo, hi in _spans(text, node.lo, node.hi, _LINE):
            level, tag, item = _heading(text, lo, hi), _TAG.match(text, lo, hi), _ITEM.match(text, lo, hi)
            own = Node(lo, hi, "line", 99, level > 0)
            if level:
                yield Node(lo, hi, "part", level), own
            elif tag:
                if tag[1]:  # a closing tag ends the element it closes
                    depth = max(0, depth - (tag[2] in _NEST))
                    own.rank = 10.5 + min(depth, _DEEP)
                    yield own, own
                else:
                    yield Node(lo, hi, "part", 10 + min(depth, _DEEP)), own
                    depth += tag[2] in _NEST
            elif item:
                yield Node(lo, hi, "part", 10 + _DEEP + min(len(item[1].expandtabs(4)) // 2, _DEEP)), own
            else:
                yield own, own

    return _nest(Node(node.lo, node.hi, "part", -1), nodes()).kids


def children(text: str, node: Node) -> list[Node]:
    """What an oversized node is opened into."""
    if node.kind == "block":
        if len(kids := _parts(text, node)) > 1:
            return kids
        node = kids[0] if kids and kids[0].kids else Node(node.lo, node.hi, "line")
    if node.kids:
        return node.kids
    if node.kind in ("line", "part"):
        if len(kids := [Node(lo, hi, "sentence") for lo, hi in _spans(text, node.lo, node.hi, _SENTENCE)]) > 1:
            return kids
    if node.kind != "word":
        if len(kids := [Node(lo, hi, "word") for lo, hi in _spans(text, node.lo, node.hi, _WORD)]) > 1:
            return kids
    return []


def _cores(text: str, node: Node, limit: int, start: int | None = None) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` that cover ``node``, and what lies between ``start`` and it."""
    begin = node.lo if start is None else start
    if node.hi - begin <= limit:
        return [(begin, node.hi)]
    kids = children(text, node)
    if not kids:
        return [(i, min(i + limit, node.hi)) for i in range(begin, node.hi, limit)]
    out: list[tuple[int, int]] = []
    lo, at = begin, node.lo  # [lo, at) are the siblings being merged
    titled = lo < at  # whether they are a heading alone
    for k in kids:
        if k.hi - lo <= limit:
            titled = k.heading and at == lo
            at = k.hi
            continue
        if k.hi - k.lo <= limit:
            if at > lo:
                out.append((lo, at))
            lo, at, titled = k.lo, k.hi, k.heading
            continue
        if titled and at - lo <= limit // 2:
            out += _cores(text, k, limit, lo)
        else:
            if at > lo:
                out.append((lo, at))
            out += _cores(text, k, limit)
        lo = at = k.hi
        titled = False
        if k.kind in ("sentence", "word"):  # not structure: filled up with what follows
            lo, at = out.pop()
    if at > lo:
        out.append((lo, at))
    return out


def _long(text: str, lo: int, hi: int, limit: int) -> bool:
    """Whether a span without outer white space is over the limit."""
    return hi - lo > limit and len(text[lo:hi].strip()) > limit


def _blocks(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.kind == "block":
            yield n
        todo += n.kids


def tree_boundary(text: str, root: Node, limit: int = LIMIT) -> str:
    """How deep the tree must be opened for all its parts to fit."""
    long = [b for b in _blocks(root) if _long(text, b.lo, b.hi, limit)]
    if not long:
        return "paragraph"
    over = lambda cut: any(_long(text, lo, hi, limit) for b in long for lo, hi in _spans(text, b.lo, b.hi, cut))
    return "sentence" if not over(_SENTENCE) else "word" if not over(_WORD) else "none"


def boundary(text: str, limit: int = LIMIT) -> str:
    return tree_boundary(text, tree(text), limit)


def _lead(text: str, before: int, at: int, overlap: int, slack: int) -> int:
    """Where the overlap in front of a piece begins: a sentence, else a word, near the wish."""
    wish = max(before, at - overlap)
    lo, hi = max(before, wish - slack), min(at, wish + slack)
    for cut in (_SENTENCE, _WORD):
        if near := [m.end() for m in cut.finditer(text, max(before, lo - 2), hi) if lo <= m.end() <= hi]:
            return min(near, key=lambda p: abs(p - wish))
    return wish


def split_tree(text: str, root: Node, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(begin, core, end) of each piece: text[begin:core] repeats the end of the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    for lo, hi in _cores(text, root, limit - overlap - slack):
        out.append((_lead(text, out[-1][0] + 1, lo, overlap, slack) if out else lo, lo, hi))
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int]]:
    return split_tree(text, tree(text), limit, overlap, slack)


_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("lead", T.IntegerType())])


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, boundary, pieces[]) of the items over the limit; the lengths are tested in the JVM."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("boundary", T.StringType()), T.StructField("pieces", T.ArrayType(_PIECE))])
    arrow = pa.list_(pa.struct([("piece", pa.int32()), ("content", pa.string()), ("lead", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, kinds = [], []
            for t in b.column(1).to_pylist():
                root = tree(t)
                made.append([{"piece": i, "content": t[a:e], "lead": c - a} for i, (a, c, e) in enumerate(split_tree(t, root, limit, overlap))])
                kinds.append(tree_boundary(t, root, limit))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(made, arrow)], names=schema.names)

    return df.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.length(text_col) > limit).mapInArrow(run, schema)


def renewed_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, document_title, chunk_index, chunk_total, content): all chunks, the oversized ones in
    pieces, numbered anew within their file by (chunk_index, created_at, id)."""
    parts = split_items(chunks, "id", "content", limit, overlap).select("id", "pieces")
    slim = chunks.select("id", "document_title", F.col("chunk_index").alias("_old"), "created_at", F.when(F.length("content") <= limit, F.col("content")).alias("_whole"))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("_whole").alias("content"), F.lit(0).alias("lead")))
    t = slim.join(parts, "id", "left").withColumn("pieces", F.coalesce("pieces", whole)).withColumn("_n", F.size("pieces"))
    t = t.withColumn("_file", F.coalesce(F.concat(F.lit("t"), "document_title"), F.concat(F.lit("i"), "id")))
    counts = with_running_total(t.select("id", "_file", "_old", "created_at", "_n"), "_file", [F.col("_old").asc_nulls_last(), F.col("created_at").asc_nulls_last(), "id"], "_n", "_first", any_hot(chunks.select(F.col("document_title")).filter("document_title is not null"), "document_title"))
    r = t.select("id", "document_title", "pieces").join(counts.select("id", "_first", "_first_all"), "id")
    return r.select("id", "document_title", "_first", "_first_all", F.inline("pieces")).select("id", "document_title", (F.col("_first") + F.col("piece")).cast("int").alias("chunk_index"), F.col("_first_all").cast("int").alias("chunk_total"), "content", "lead")
