"""Ingest: pages to cleaned, numbered, embedded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, maybe_broadcast
from . import chunking
from .embedding import Embedder, embed
from .ordered import any_hot


def header_lines(pages: DataFrame) -> DataFrame:
    """AGG-05, MTH-04: (document_title, line) of lines on more than half of a document's pages,
    two at least; documents of one or two pages have none.  Distinct raw lines of a page count."""
    n = pages.groupBy("document_title").agg(F.count("*").alias("pages")).filter("pages >= 3")
    raw = pages.select("document_title", F.explode(F.array_distinct(text.lines(F.col("text")))).alias("raw"))
    lines = raw.select("document_title", text.strip(F.col("raw")).alias("line")).filter("line != ''")
    counts = lines.groupBy("document_title", "line").agg(F.count("*").alias("seen"))
    return counts.join(n, "document_title").filter(F.col("seen") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2) + 1)).select("document_title", "line")


def without_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """JN-09: (document_title, page_number, position, line) of the lines that are no header."""
    lines = pages.select("document_title", "page_number", F.posexplode(text.lines(F.col("text"))).alias("position", "raw"))
    stripped = lines.select("document_title", "page_number", "position", text.strip(F.col("raw")).alias("line"))
    return stripped.join(headers, ["document_title", "line"], "left_anti").select("document_title", "page_number", "position", "line")


def cleaned_pages(pages: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """STR-01 with AGG-05: pages without header, digit and "Page n" lines."""
    headers = header_lines(pages) if headers is None else headers
    own = headers.groupBy("document_title").agg(F.collect_set("line").alias("headers"))  # at most the lines of a page
    return pages.join(own, "document_title", "left").select("document_title", "page_number", text.clean_text(F.col("text"), F.col("headers")).alias("text"))


def document_types(pages: DataFrame) -> DataFrame:
    """STR-06, WIN-07: readers named by the file's path (its title, where pages have no ``path``),
    else by the first two pages.  Pages are tested one by one and only the answers are gathered,
    so files of one name are no burden."""
    low = F.lower(F.coalesce("text", F.lit("")))
    early = F.coalesce(F.col("page_number") <= 2, F.lit(False))
    named = lambda words: F.max(early & low.rlike("|".join(words)))
    t = pages.groupBy("document_title").agg(named(text.TEACHER).alias("t"), named(text.STUDENT).alias("s"), F.min("path" if "path" in pages.columns else "document_title").alias("where"))
    by_title = text.manual_type(F.col("where"))
    return t.select("document_title", F.when(by_title != "", by_title).when(F.col("t"), "teacher").when(F.col("s"), "student").otherwise("").alias("manual_type"))


def document_links(pages: DataFrame) -> DataFrame:
    """STR-07, WIN-06: the first link of each document in page order, or nothing."""
    link = text.first_link(F.coalesce("text", F.lit("")))
    found = pages.select("document_title", "page_number", F.when(link != "", link).alias("link"))
    return found.groupBy("document_title").agg(F.coalesce(F.min_by("link", F.when(F.col("link").isNotNull(), F.struct(F.coalesce("page_number", F.lit(2**31 - 1)), "link"))), F.lit("")).alias("source_url"))


def sections(documents: DataFrame, key: str, column: str) -> DataFrame:
    """WIN-08: each line with the last heading at or before it in its document."""
    lines = documents.select(key, F.posexplode(text.lines(F.col(column))).alias("position", "raw")).withColumn("line", text.strip(F.col("raw")))
    lines = lines.filter("line != ''").withColumn("heading", text.heading(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select(key, "position", "line", F.last("heading", ignorenulls=True).over(so_far).alias("section"))


def statistics(pages: DataFrame, ocr: Column | None = None) -> DataFrame:
    """AGG-10: one row of counts over all pages."""
    blank = text.strip(F.coalesce("text", F.lit(""))) == ""
    return pages.agg(F.count_distinct("document_title").alias("files"), F.count("*").alias("pages"), F.count_if(blank).alias("blank_pages"), F.count_if(ocr if ocr is not None else F.lit(False)).alias("ocr_pages"))


def ingest(pages: DataFrame, embedder: Embedder, size: int = chunking.CHUNK_TOKENS, overlap: int = chunking.OVERLAP_TOKENS, dry_run: bool = False) -> DataFrame:
    """ING-01: pages (document_title, page_number, text) to rows of ``chunks`` with status and
    error.  Vectors are joined to their chunk by being computed in its row, so a failed batch
    leaves nulls and no misalignment."""
    hot = any_hot(pages.select("document_title"), "document_title")
    made = chunking.numbered(chunking.chunk_pages(cleaned_pages(pages), size, overlap), hot)
    of_file = document_types(pages).withColumnRenamed("document_title", "_t").join(document_links(pages).withColumnRenamed("document_title", "_l"), F.col("_t").eqNullSafe(F.col("_l"))).drop("_l")
    t = made.join(maybe_broadcast(cut(of_file)), F.col("document_title").eqNullSafe(F.col("_t")), "left")
    rows = t.select(F.expr("uuid()").alias("id"), "content", "document_title", "source_url", "manual_type", "chunk_index", "page_number", F.col("chunk_total").cast("int"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    return embed(rows, "content", embedder, dry_run)
