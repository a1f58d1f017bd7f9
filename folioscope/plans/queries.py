"""The registered queries of the core; each takes (spark, folder of tables) and runs over whole
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, vector
from ..operators import chat, chunking, embedding, history, ingest, retrieval, shred
from ..operators.ordered import any_hot
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUESTION = "How long does the gradebook keep a reading list?"
CHINESE = "成績冊在哪裡？"
DEVICE = "device_kiosk_hall"
MODEL = "kestrel-mini-32"
DIM = 64


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as pages; a chunk without page number has none."""
    return table(spark, d, "chunks").select("document_title", "page_number", F.col("content").alias("text"))


def _vector(spark: SparkSession, d: str) -> list[float] | None:
    return vector.usable_vector(_chunks(spark, d), "id", "embedding", DIM)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


# problem 4 of the pipeline: nested records


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object in the arrays of chat_history.sources by message and path."""
    return shred.source_paths(table(spark, d, "chat_history"))


@query
def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of chat_history.sources with parent links and own fields."""
    return shred.source_tables(table(spark, d, "chat_history"))


def _p4_typed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return shred.typed(shred.source_tables(table(spark, d, "chat_history")), kind, shred.COLUMNS[kind])


@query
def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """The table of sources with typed columns."""
    return _p4_typed(spark, d, "sources")


@query
def p4_related(spark: SparkSession, d: str) -> DataFrame:
    """The table of related sources, at any depth, with their parents."""
    return _p4_typed(spark, d, "related")


@query
def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    """The table of passages with their parents."""
    return _p4_typed(spark, d, "passages")


@query
def p4_highlights(spark: SparkSession, d: str) -> DataFrame:
    """The table of highlights with their parents."""
    return _p4_typed(spark, d, "highlights")


# retrieval


@query
def mth01_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """MTH-01, FLT-03, SRT-01, JN-10: nearest chunks over the threshold."""
    return _rounded(retrieval.top_k(_chunks(spark, d), _vector(spark, d)))


@query
def flt02_cosine_topk_typed(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01/02: the same within one manual type."""
    return _rounded(retrieval.top_k(_chunks(spark, d), _vector(spark, d), manual_type="teacher"))


@query
def jn03_neighbour_indices(spark: SparkSession, d: str) -> DataFrame:
    """JN-03, FLT-06, AGG-06, ARR-02."""
    return retrieval.neighbour_indices(retrieval.top_k(_chunks(spark, d), _vector(spark, d)))


@query
def ret01_search(spark: SparkSession, d: str) -> DataFrame:
    """RET-01, UDF-01, JN-01/02, PRJ-01, SRT-02: vector search with neighbour expansion."""
    found = _rounded(retrieval.search(_chunks(spark, d), _vector(spark, d)))
    return found.select("id", "document_title", "chunk_index", "manual_type", "similarity").orderBy("document_title", "chunk_index", "id")


@query
def ret01_search_typed(spark: SparkSession, d: str) -> DataFrame:
    """RET-01 with a type filter, which neighbours bypass."""
    found = _rounded(retrieval.search(_chunks(spark, d), _vector(spark, d), manual_type="student"))
    return found.select("id", "document_title", "chunk_index", "manual_type", "similarity")


@query
def mth02_relevance(spark: SparkSession, d: str) -> DataFrame:
    """MTH-02, STR-14: lexical score of every chunk."""
    return _chunks(spark, d).select("id", retrieval.relevance(QUESTION).alias("score"))


@query
def mth02_relevance_cjk(spark: SparkSession, d: str) -> DataFrame:
    """MTH-02 for a Chinese question."""
    return _chunks(spark, d).select("id", retrieval.relevance(CHINESE).alias("score"))


@query
def ret02_rerank(spark: SparkSession, d: str) -> DataFrame:
    """RET-02, SRT-03, WIN-02/03: the best chunk of the best titles over all chunks."""
    r = retrieval.rerank(_chunks(spark, d), QUESTION, [F.col("chunk_index").asc_nulls_last(), "id"])
    return r.select("id", "document_title", "score", "rank")


@query
def set01_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, SET-01, SRT-08: title matches of each term."""
    return retrieval.candidates(_chunks(spark, d), QUESTION).select("phase", "term_no", "row_no", "id")


@query
def flt05_candidates_content(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05: content matches where titles give too few."""
    return retrieval.candidates(_chunks(spark, d), "zylophone password hidden comments").select("phase", "term_no", "row_no", "id")


@query
def win05_first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05: the first ten chunks of every title."""
    c = _chunks(spark, d)
    return retrieval.first_chunks(c, c.select("document_title").distinct()).select("id", "document_title", "chunk_index")


@query
def ret03_expand(spark: SparkSession, d: str) -> DataFrame:
    """RET-03, SET-02, JN-07, SRT-07 on a rerank of all chunks."""
    c = _chunks(spark, d).withColumn("similarity", F.lit(0.5))
    r = retrieval.rerank(c, QUESTION, [F.col("chunk_index").asc_nulls_last(), "id"])
    return retrieval.expand(r, c).select("id", "document_title", "chunk_index", "similarity", "title_rank")


@query
def ret04_fallback(spark: SparkSession, d: str) -> DataFrame:
    """RET-04: lexical retrieval."""
    return retrieval.fallback(_chunks(spark, d), QUESTION).select("id", "document_title", "chunk_index", "title_rank")


@query
def ret05_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """RET-05: vector search, rerank and expansion."""
    return _rounded(retrieval.retrieve(_chunks(spark, d), QUESTION, _vector(spark, d))).select("id", "document_title", "chunk_index", "similarity", "title_rank")


@query
def ret06_sources(spark: SparkSession, d: str) -> DataFrame:
    """RET-06, STR-08, MTH-03, PRJ-03, WIN-04: citations of every link."""
    c = _chunks(spark, d).withColumn("similarity", F.lit(0.5))
    return retrieval.format_sources(c, ["id"])


@query
def mth03_display_similarity(spark: SparkSession, d: str) -> DataFrame:
    """MTH-03 of every usable chunk against one vector."""
    near = vector.cosine_to(_chunks(spark, d), "id", "embedding", _vector(spark, d))
    return near.select("id", (F.round(retrieval.display_similarity(F.col("similarity")), 1) + 0.0).alias("shown"))


@query
def ret07_context(spark: SparkSession, d: str) -> DataFrame:
    """RET-07, AGG-08, STR-16: prompt blocks of a retrieval."""
    return retrieval.context_blocks(retrieval.fallback(_chunks(spark, d), QUESTION))


@query
def str17_sources_markdown(spark: SparkSession, d: str) -> DataFrame:
    """STR-17: bullet lines of all citations."""
    return retrieval.sources_markdown(ret06_sources(spark, d))


# text


@query
def str01_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """STR-01: every document cleaned."""
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query
def str02_headings(spark: SparkSession, d: str) -> DataFrame:
    """STR-02: the first heading of every document."""
    return table(spark, d, "documents").select("doc_id", text.heading(F.col("text")).alias("heading")).filter("heading is not null")


@query
def str03_sentences(spark: SparkSession, d: str) -> DataFrame:
    """STR-03: the sentences of every document, counted, with the longest."""
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query
def str05_words(spark: SparkSession, d: str) -> DataFrame:
    """STR-05: size in words, the default tokens."""
    found = F.size(F.regexp_extract_all("text", F.lit(rf"([^\n{text.SPACE}]+)"), 1))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", found.alias("words"))


@query
def agg05_headers(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, MTH-04, SET-03: lines on more than half of a file's pages."""
    return ingest.header_lines(_pages(spark, d))


@query
def jn09_lines_left(spark: SparkSession, d: str) -> DataFrame:
    """JN-09: lines of each file that are no header, counted."""
    p = _pages(spark, d)
    left = ingest.without_headers(p, ingest.header_lines(p))
    return left.filter("line != ''").groupBy("document_title").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query
def str06_manual_types(spark: SparkSession, d: str) -> DataFrame:
    """STR-06, WIN-07: readers of each file."""
    return ingest.document_types(_pages(spark, d))


@query
def str07_links(spark: SparkSession, d: str) -> DataFrame:
    """STR-07, WIN-06: the first link of each file by page, the links standing in source_url."""
    p = table(spark, d, "chunks").select("document_title", "page_number", F.col("source_url").alias("text"))
    return ingest.document_links(p)


@query
def str08_source_urls(spark: SparkSession, d: str) -> DataFrame:
    """STR-08: every link of the chunks in one spelling."""
    return _chunks(spark, d).select("id", text.source_url(F.coalesce("source_url", F.lit(""))).alias("url"))


@query
def str09_cjk(spark: SparkSession, d: str) -> DataFrame:
    """STR-09/10: messages with Chinese characters and their number."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    return h.select("id", text.has_cjk(F.col("user_message")).alias("has_cjk"), F.size(text.cjk_terms(F.col("user_message"))).alias("characters"))


@query
def str11_word_terms(spark: SparkSession, d: str) -> DataFrame:
    """STR-11: terms of every message."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    return h.select("id", F.array_join(text.word_terms(F.col("user_message")), "|").alias("terms"))


@query
def str12_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """STR-12: how often each term is asked for."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    return h.select(F.explode(text.query_terms(F.col("user_message"))).alias("term")).groupBy("term").agg(F.count("*").alias("uses"))


@query
def str13_phrases(spark: SparkSession, d: str) -> DataFrame:
    """STR-13: phrases of every message."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    t = h.select("id", text.word_terms(F.col("user_message")).alias("terms"))
    return t.select("id", F.array_join(text.phrases(F.col("terms"), 3), "|").alias("phrases"))


@query
def flt10_prefixed(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09/10: messages routed by their prefix; blank ones are refused."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    kind, rest = text.prefixed(F.col("user_message"))
    return h.select("id", kind.alias("kind"), rest.alias("message")).filter("message != ''")


@query
def str18_demo_reply(spark: SparkSession, d: str) -> DataFrame:
    """STR-18: the reply without a model to every message, once with and once without a title."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    with_title = chat.demo_reply(F.col("user_message"), F.array(F.lit("Guide"), F.col("device_id")))
    return h.select("id", with_title.alias("reply"), chat.demo_reply(F.col("user_message"), F.array().cast("array<string>")).alias("bare_reply"))


@query
def dte02_clock(spark: SparkSession, d: str) -> DataFrame:
    """DTE-02: the time shown beside each message."""
    return history.once(table(spark, d, "chat_history")).select("id", ids.clock(F.col("created_at")).alias("shown"))


@query
def str20_previews(spark: SparkSession, d: str) -> DataFrame:
    """STR-20: short ids and titles."""
    return _chunks(spark, d).select("id", F.substring("id", 1, 8).alias("short_id"), F.substring("document_title", 1, 40).alias("short_title"))


@query
def win08_sections(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08: lines under each section of each document."""
    s = ingest.sections(table(spark, d, "documents"), "doc_id", "text")
    return s.groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("lines"))


# history


@query
def his01_device_sessions(spark: SparkSession, d: str) -> DataFrame:
    """HIS-01, SRT-05, FLT-01, JN-06: the sessions updated last of one device."""
    return history.device_sessions(table(spark, d, "chat_sessions"), table(spark, d, "chat_history"), DEVICE).select("id", "title", "updated_at", "message_count")


@query
def his01_all_devices(spark: SparkSession, d: str) -> DataFrame:
    """HIS-01 for every device."""
    return history.device_sessions(table(spark, d, "chat_sessions"), table(spark, d, "chat_history")).select("device_id", "id", "place", "message_count")


@query
def his02_history(spark: SparkSession, d: str) -> DataFrame:
    """HIS-02, SRT-06, JSN-03: messages with the number of citations that are one flat list."""
    h = history.once(table(spark, d, "chat_history"))
    return h.select("session_id", "id", "created_at", F.coalesce(F.json_array_length("sources"), F.lit(0)).alias("citations"))


@query
def jsn03_session_history(spark: SparkSession, d: str) -> DataFrame:
    """HIS-02, JSN-03: all messages in order with their citations parsed."""
    return history.session_history(table(spark, d, "chat_history"))


@query
def arr03_flattened(spark: SparkSession, d: str) -> DataFrame:
    """ARR-03: both sides of every message with their sizes."""
    return history.flattened(table(spark, d, "chat_history")).select("id", "side", "sender", F.length("text").alias("characters"))


@query
def str15_session_titles(spark: SparkSession, d: str) -> DataFrame:
    """STR-15: the title each message would give."""
    h = history.once(table(spark, d, "chat_history")).filter("user_message is not null")
    return h.select("id", text.session_title(F.col("user_message")).alias("title"))


@query
def agg01_message_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, JN-06: messages of every session."""
    return history.message_counts(table(spark, d, "chat_history"), table(spark, d, "chat_sessions")).select("id", "message_count")


@query
def jn05_owned(spark: SparkSession, d: str) -> DataFrame:
    """JN-05: messages whose session is their device's."""
    return history.owned(table(spark, d, "chat_history"), table(spark, d, "chat_sessions")).select("id", "session_id", "device_id")


@query
def his03_requests(spark: SparkSession, d: str) -> DataFrame:
    """HIS-03: devices asking for the sessions of their messages; whether each must be created."""
    r = history.once(table(spark, d, "chat_history")).select("device_id", "session_id").distinct()
    opened = history.create_or_get(table(spark, d, "chat_sessions"), r)
    return opened.groupBy("device_id", "created").agg(F.count("*").alias("sessions"))


@query
def his04_saved(spark: SparkSession, d: str) -> DataFrame:
    """HIS-04, SNK-08: sessions after all messages were saved again."""
    m = history.once(table(spark, d, "chat_history")).filter("session_id is not null and created_at is not null")
    return history.saved(table(spark, d, "chat_sessions"), m).select("id", "title", "updated_at")


@query
def snk09_logged(spark: SparkSession, d: str) -> DataFrame:
    """SNK-09: sessions touched by their last message."""
    m = history.once(table(spark, d, "chat_history")).filter("session_id is not null")
    return history.logged(table(spark, d, "chat_sessions"), m).select("id", "updated_at")


@query
def snk12_surviving(spark: SparkSession, d: str) -> DataFrame:
    """SNK-12: messages and vectors whose parent exists."""
    h = history.surviving(history.once(table(spark, d, "chat_history")).select("id", "session_id"), table(spark, d, "chat_sessions"), "session_id")
    e = history.surviving(table(spark, d, "document_embeddings").select("id", "document_id"), _chunks(spark, d), "document_id")
    return h.select(F.lit("chat_history").alias("child"), "id").unionByName(e.select(F.lit("document_embeddings").alias("child"), "id"))


# embeddings, counts, ingest


@query
def jn04_pending(spark: SparkSession, d: str) -> DataFrame:
    """JN-04: chunks without a vector of the model."""
    return embedding.pending(_chunks(spark, d), table(spark, d, "document_embeddings"), MODEL).select("id")


@query
def jn04_pending_limited(spark: SparkSession, d: str) -> DataFrame:
    """JN-04, SRC-04: the feature's limit counts before rows with a vector are left out."""
    return embedding.pending(_chunks(spark, d), table(spark, d, "document_embeddings"), MODEL, 100).select("id")


@query
def emb03_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """EMB-03: a dry run's zero vectors."""
    done = embedding.results(_chunks(spark, d), MODEL, embedding.HashEmbedder(32), dry_run=True)
    return done.select("document_id", "model_name", "status", F.size("embedding").alias("dimensions"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def agg11_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11: embedding results counted; blank texts have no vector."""
    return embedding.status_counts(embedding.results(_chunks(spark, d), MODEL, embedding.HashEmbedder(32)))


def _upserted(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    new = chunks.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("document_id"), F.lit(MODEL).alias("model_name"), F.array_repeat(F.lit(0.0).cast("float"), 32).alias("embedding"))
    return embedding.upserted(table(spark, d, "document_embeddings"), new).select("id", "document_id", "model_name", F.size(F.coalesce("embedding", F.array().cast("array<float>"))).alias("dimensions"))


@query
def snk03_upserted(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: vectors of repeated keys merged, zero vectors of all chunks over them."""
    return _upserted(spark, d, _chunks(spark, d))


@query
def agg02_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02/04/12, FLT-07: chunks and those with a vector."""
    return _chunks(spark, d).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))


@query
def agg03_chunks_per_title(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03."""
    return _chunks(spark, d).groupBy("document_title").agg(F.count("*").alias("chunks"))


@query
def agg09_numbering(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01, AGG-09: chunks numbered anew within their file."""
    c = _chunks(spark, d).select("id", "document_title", F.coalesce("page_number", F.lit(2**31 - 1)).alias("page_number"), F.struct(F.coalesce("chunk_index", F.lit(2**31 - 1)), "id").alias("position"))
    return chunking.numbered(c, any_hot(c.select("document_title"), "document_title")).select("id", F.col("chunk_index").alias("new_index"), F.col("chunk_total").alias("new_total"))


@query
def snk10_recent(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10, SRT-04, PRJ-02: the newest 100 chunks."""
    from ..sources.sinks import recent_view

    return recent_view(_chunks(spark, d))


@query
def agg10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: files and pages."""
    return ingest.statistics(_pages(spark, d))


@query
def prj03_defaults(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-03/04: records with defaults."""
    c = _chunks(spark, d)
    return c.select("id", F.coalesce("document_title", F.lit("Unknown")).alias("title"), F.coalesce(F.nullif("manual_type", F.lit("")), F.lit("Unknown")).alias("type"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))


@query
def src05_projection(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05: a pruned scan with a pushed-down filter."""
    return table(spark, d, "chunks", "id", "document_title", "chunk_index", "manual_type").filter("manual_type = 'teacher'")


@query
def jsn01_fields(spark: SparkSession, d: str) -> DataFrame:
    """JSN-01: a field of the JSON of every event."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def snk02_inserted(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02, UDF-02, JSN-02, ARR-01: chunks written as JSON and inserted again, by title."""
    from ..sources.sinks import from_json_rows

    rows = _chunks(spark, d).select(F.array(F.to_json(F.struct("content", "document_title", "source_url", "manual_type"))).alias("rows"))
    return from_json_rows(rows, "rows").groupBy("document_title").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))


@query
def str04_chunks(spark: SparkSession, d: str) -> DataFrame:
    """STR-04, ING-01: documents cut into chunks of 100 words overlapping by 10, numbered."""
    from ..operators import chunking

    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_title"), F.lit(1).alias("page_number"), "text")
    return chunking.numbered(chunking.chunk_pages(pages, 100, 10)).select("document_title", "chunk_index", "chunk_total", "section", "content")


@query
def ing01_ingest(spark: SparkSession, d: str) -> DataFrame:
    """ING-01: all pages through cleaning, chunking, typing, links and embedding."""
    made = ingest.ingest(_pages(spark, d), embedding.HashEmbedder(64), 100, 10)
    return made.select("document_title", "page_number", "chunk_index", "chunk_total", "manual_type", "source_url", "content", "status")


@query
def ing02_reembed(spark: SparkSession, d: str) -> DataFrame:
    """ING-02: pending chunks embedded and upserted, counted by model."""
    e = table(spark, d, "document_embeddings")
    done = embedding.results(embedding.pending(_chunks(spark, d), e, MODEL), MODEL, embedding.HashEmbedder(32))
    new = done.filter("status = 'success'").select(F.concat(F.lit("new-"), "document_id").alias("id"), "document_id", "model_name", "embedding")
    return embedding.upserted(e, new).groupBy("model_name").agg(F.count("*").alias("vectors"))
