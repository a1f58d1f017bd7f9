"""Retrieval: vector search with neighbours, lexical rerank, context expansion, citations.

Null titles and contents count as empty, null indexes never match a neighbour; every order has
the id as its last key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..session import cut, maybe_broadcast

LIMIT, THRESHOLD, CALLER_THRESHOLD = 8, 0.1, 0.2
COLUMNS = ["id", "content", "document_title", "source_url", "manual_type", "chunk_index", "page_number", "chunk_total"]


def top_k(chunks: DataFrame, query: Sequence[float], threshold: float = THRESHOLD, count: int = LIMIT, manual_type: str | None = None) -> DataFrame:
    """SRT-01, FLT-02/03: (id, document_title, chunk_index, similarity) of the nearest chunks."""
    if manual_type is not None:
        chunks = chunks.filter(F.col("manual_type") == manual_type)
    near = vector.cosine_to(chunks, "id", "embedding", query, "document_title", "chunk_index")
    return near.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(count)


def neighbour_indices(matched: DataFrame) -> DataFrame:
    """JN-03, FLT-06, AGG-06: distinct (document_title, chunk_index) of hits and their sides."""
    i = F.col("chunk_index")
    return matched.select("document_title", F.explode(F.array(i - 1, i, i + 1)).alias("chunk_index")).filter("chunk_index >= 0").distinct()


def search(chunks: DataFrame, query: Sequence[float], threshold: float = THRESHOLD, count: int = LIMIT, manual_type: str | None = None) -> DataFrame:
    """RET-01, AGG-07: hits with the chunks before and after them.  Neighbours bypass the threshold and
    the type filter and have similarity 0.  Vectors are scanned once and contents once; both
    joins are against at most 3 x ``count`` rows."""
    matched = cut(top_k(chunks, query, threshold, count, manual_type))  # a few rows, read twice below
    needed = F.broadcast(neighbour_indices(matched))  # at most 3 x count rows
    hits = F.broadcast(matched.select("id", "similarity"))  # at most count rows
    found = chunks.select(*COLUMNS).join(needed, ["document_title", "chunk_index"]).join(hits, "id", "left")
    return found.select(*COLUMNS, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def relevance(question: str, title: str = "document_title", content: str = "content") -> Column:
    """MTH-02: the lexical score of a row for one question; the terms are unrolled, so the sum
    stays inside generated code."""
    terms, cjk = text.terms_of(question)
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.substring(F.lower(F.coalesce(content, F.lit(""))), 1, 800)
    score = F.lit(0)
    for words, in_title, in_content in ((text.phrases_of(terms, 4, "" if cjk else " "), 1000, 50), (terms, 100, 10)):
        for w in words:
            score = score + F.when(t.contains(w), in_title).otherwise(0) + F.when(c.contains(w), in_content).otherwise(0)
    return score.cast("double")


def rerank(candidates: DataFrame, question: str, position: Sequence[Column | str], k: int = LIMIT) -> DataFrame:
    """RET-02: the best row of each title by (score, position), the ``k`` best titles by
    (score, title); adds ``score`` and ``rank`` from 0."""
    scored = candidates.withColumn("score", relevance(question)).withColumn("_title", F.coalesce("document_title", F.lit("")))
    one = scored.withColumn("_r", F.row_number().over(Window.partitionBy("_title").orderBy(F.desc("score"), *position))).filter("_r = 1").drop("_r")
    best = one.orderBy(F.desc("score"), "_title").limit(k)
    # at most k rows are ranked in one task, and kept, as they are read several times
    return cut(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "_title")) - 1).drop("_title"))


def first_chunks(chunks: DataFrame, titles: DataFrame, count: int = 10) -> DataFrame:
    """WIN-05: the first ``count`` chunks of each of a few titles."""
    order = Window.partitionBy("document_title").orderBy(F.col("chunk_index").asc_nulls_last(), "id")
    own = chunks.select(*COLUMNS).join(maybe_broadcast(titles.select("document_title")), "document_title", "left_semi")
    return own.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= count).drop("_r")


def expand(reranked: DataFrame, chunks: DataFrame, titles: int = 3, count: int = 10) -> DataFrame:
    """RET-03, SET-02, SRT-07: reranked rows and the first chunks of the best titles, each id
    once with the reranked row first, in (rank of the title, chunk_index); fetched rows have no
    similarity."""
    ranks = F.broadcast(reranked.select("document_title", F.col("rank").alias("_rank")))  # at most k rows
    top = reranked.filter((F.col("rank") < titles) & (F.coalesce("document_title", F.lit("")) != "")).select("document_title")
    first = reranked.select(*COLUMNS, "similarity", F.lit(0).alias("_from"))
    more = first_chunks(chunks, top, count).select(*COLUMNS, F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("_from"))
    all_ = first.unionByName(more)
    once = all_.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("_from"))).filter("_r = 1").drop("_r", "_from")
    return once.join(ranks, "document_title", "left").withColumn("title_rank", F.coalesce("_rank", F.lit(9999))).select(*COLUMNS, "similarity", "title_rank")


def candidates(chunks: DataFrame, question: str, limit: int = LIMIT) -> DataFrame:
    """FLT-04/05, FLT-11, SET-01: title matches of each term, 2 x ``limit`` a term; if there are fewer
    than ``limit``, content matches of the first three terms too, ``limit`` a term.  One scan a
    phase: every row lists the terms it has, and a pruned window keeps the first ids."""
    terms, _ = text.terms_of(question)

    def matches(column: str, words: list[str], phase: int, most: int) -> DataFrame:
        low = F.lower(F.col(column))
        which = F.filter(F.array(*(F.when(low.contains(w), F.lit(i)) for i, w in enumerate(words))), lambda x: x.isNotNull())
        hit = chunks.select(*COLUMNS, F.explode(which).alias("term_no"))
        order = Window.partitionBy("term_no").orderBy("id")
        return hit.withColumn("row_no", F.row_number().over(order)).filter(F.col("row_no") <= most).withColumn("phase", F.lit(phase))

    if not terms:
        return chunks.select(*COLUMNS).limit(0).withColumns({"term_no": F.lit(0), "row_no": F.lit(0), "phase": F.lit(0)})
    by_title = cut(matches("document_title", terms, 0, 2 * limit))  # at most 2 x limit rows a term
    if by_title.limit(limit).count() >= limit:
        return by_title
    return by_title.unionByName(matches("content", terms[:3], 1, limit))


def fallback(chunks: DataFrame, question: str, limit: int = LIMIT) -> DataFrame:
    """RET-04: lexical retrieval; a manual type is not applied."""
    found = candidates(chunks, question, limit).withColumn("similarity", F.lit(None).cast("double"))
    return expand(rerank(found, question, ["phase", "term_no", "row_no"], limit), chunks)


def retrieve(chunks: DataFrame, question: str, query: Sequence[float] | None, manual_type: str | None = None, limit: int = LIMIT) -> DataFrame:
    """RET-05: vector search, rerank, expansion; lexical retrieval without a vector or a hit."""
    if query is not None:
        hits = cut(search(chunks, query, CALLER_THRESHOLD, limit, manual_type))
        if not hits.isEmpty():
            return expand(rerank(hits, question, [F.col("chunk_index").asc_nulls_last(), "id"], limit), chunks)
    return fallback(chunks, question, limit)


def display_similarity(c: Column) -> Column:
    """MTH-03: percent of a similarity in [0, 1], else 20 times the value up to 100."""
    return F.coalesce(F.when(c.between(0, 1), F.round(c * 100, 1)).otherwise(F.round(F.least(c * 20, F.lit(100.0)), 1)), F.lit(0.0))


def format_sources(documents: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """RET-06, WIN-04, PRJ-03: one citation a link, the first in ``order``."""
    d = documents.withColumn("url", text.source_url(F.coalesce("source_url", F.lit("")))).filter("url != ''")
    one = d.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(*order))).filter("_r = 1")
    kind = F.when(F.coalesce("manual_type", F.lit("")) == "", "Unknown").otherwise(F.col("manual_type"))
    return one.select(F.coalesce("document_title", F.lit("Unknown")).alias("title"), "url", kind.alias("type"), F.col("page_number").alias("page"), display_similarity(F.coalesce("similarity", F.lit(0.0))).alias("similarity"))


def context_blocks(documents: DataFrame) -> DataFrame:
    """AGG-08, STR-16: a prompt block for each title of a retrieved (small) set."""
    item = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "id", F.coalesce("content", F.lit("")).alias("content"))
    g = documents.groupBy("document_title").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min_by("source_url", F.struct(F.coalesce("chunk_index", F.lit(0)), "id")).alias("url"))
    url = text.strip(F.coalesce("url", F.lit("")))
    body = F.array_join(F.transform("items", lambda x: x["content"]), "\n")
    head = F.concat(F.lit("SOURCE: "), F.coalesce("document_title", F.lit("Unknown Document")), F.when(url != "", F.concat(F.lit("\nURL: "), url)).otherwise(""))
    return g.select("document_title", F.concat(head, F.lit("\n\n```\n"), body, F.lit("\n```")).alias("block"))


def sources_markdown(sources: DataFrame) -> DataFrame:
    """STR-17: a bullet line for each citation."""
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    return sources.select("url", F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), page).alias("line"))
