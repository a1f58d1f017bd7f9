"""Chunks of about a number of tokens with an overlap, made page by page (STR-04, WIN-09).

The fold over sentences is sequential, so it runs over Arrow batches; numbering and totals are
windows (WIN-01, AGG-09).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import HOT_ROWS, with_running_total

CHUNK_TOKENS, OVERLAP_TOKENS = 500, 50

_SENTENCE = re.compile(r"(?<=[.?!])\s+")

Encode = Callable[[str], list]
Decode = Callable[[list], str]


def words(text: str) -> list[str]:
    """The default tokens: words between white space."""
    return text.split()


def heading(text: str) -> str | None:
    """STR-02 for one text: the first line marked with #, or in capitals with under ten words."""
    for line in (x.strip() for x in text.splitlines()):
        if line.startswith("#"):
            return line.lstrip("# ").strip()
        if line and line.isupper() and len(line.split()) < 10:
            return line
    return None


def chunk_page(text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, encode: Encode = words, decode: Decode = " ".join) -> list[tuple[str, str]]:
    """(chunk, section) of a page.  Sentences are added until the next would pass ``size``; a
    new chunk begins with the last ``overlap`` tokens of a longer chunk before it; a sentence
    over ``size`` is one chunk.  A section is the last heading met before the chunk ended."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    tokens, section = 0, ""

    def flush() -> None:
        if chunk := " ".join(held).strip():
            out.append((chunk, section))

    for sentence in filter(None, _SENTENCE.split(text)):
        n = len(encode(sentence))
        if tokens + n > size:
            flush()
            held, tokens = [], 0
            if out and len(tail := encode(out[-1][0])) > overlap:
                held, tokens = [decode(tail[-overlap:])], overlap
        held.append(sentence)
        tokens += n
        section = heading(sentence) or section
    flush()
    return out


_CHUNKS = T.StructType([T.StructField(n, t) for n, t in (("document_title", T.StringType()), ("page_number", T.IntegerType()), ("position", T.IntegerType()), ("content", T.StringType()), ("section", T.StringType()))])


def chunk_pages(pages: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, encode: Encode = words, decode: Decode = " ".join) -> DataFrame:
    """Chunks of pages (document_title, page_number, text); null pages give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, p, i, c, s) for d, p, t in zip(*(c.to_pylist() for c in b.columns)) for i, (c, s) in enumerate(chunk_page(t or "", size, overlap, encode, decode))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=_CHUNKS.names)

    return pages.select("document_title", F.col("page_number").cast("int"), "text").mapInArrow(run, _CHUNKS)


def numbered(chunks: DataFrame, hot: bool = False, limit: int = HOT_ROWS) -> DataFrame:
    """WIN-01, AGG-09: chunk_index from 0 and chunk_total of each document.  ``hot`` says that
    a document may have very many chunks; it is then numbered in buckets of pages."""
    if hot:
        ones = chunks.withColumn("_one", F.lit(1).cast("long"))
        n = with_running_total(ones, "document_title", ["page_number", "position"], "_one", "_place", True, limit)
        return n.withColumn("chunk_index", F.col("_place").cast("int")).withColumnRenamed("_place_all", "chunk_total").drop("_place", "_one")
    own = Window.partitionBy("document_title")
    return chunks.withColumns({"chunk_index": F.row_number().over(own.orderBy("page_number", "position")) - 1, "chunk_total": F.count("*").over(own)})
