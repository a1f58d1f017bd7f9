"""The registered queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import conversations, language, leakage, mixing, pairs, scans, severity, similar, split
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to drop, with the reason."""
    return conversations.rejected(table(spark, d, "chat_history"), table(spark, d, "chat_sessions"))


@query
def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the conversations kept."""
    return conversations.turns(table(spark, d, "chat_history"), table(spark, d, "chat_sessions"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over 1,000 characters, cut into pieces, with the boundary at which they must be cut."""
    return split.split_items(table(spark, d, "chunks"), "id", "content").filter("size(pieces) > 1").select("id", "boundary")


@query
def p6_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks with the oversized ones in pieces, numbered anew."""
    return split.renewed_chunks(table(spark, d, "chunks"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that stay under their target."""
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every copy with its text, shuffled."""
    return mixing.written(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by the mixture."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _records(spark: SparkSession, d: str, read=language.languages) -> DataFrame:
    return language.all_records(table(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "chunks", "id", "content"), table(spark, d, "chat_history", "id", "user_message"), table(spark, d, "lang_labels"), read=read)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with a missing or wrong label, and mixed texts."""
    return language.issues(_records(spark, d))


@query
def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every record: language, confidence, begin and end."""
    return _records(spark, d, language.language_spans).selectExpr("record_table", "record_id", "label", "inline(segments)")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a passage of a test item."""
    return leakage.contained(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


@query
def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that align at least as well as ten words in a row, edited copies included."""
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defect."""
    lid = language.fit(language.sample(table(spark, d, "documents", "doc_id", "text", "lang")))
    return pairs.defects(table(spark, d, "chat_history"), lid=lid)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other."""
    return similar.pairs(table(spark, d, "chunks", "id", "embedding"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "source", "text")
    return severity.scores(documents, severity.fit(severity.sample(documents, table(spark, d, "doc_labels"))))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return severity.cases(_scored(spark, d))


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Expected severity of every document."""
    return _scored(spark, d)


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of cases by source."""
    return severity.rates(_scored(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "id", "document_title", "page_number", "content")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages with each kind of noise."""
    return scans.noises(_pages(spark, d))


@query
def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as readable paragraphs."""
    return scans.paragraphs(_pages(spark, d))


@query
def p2_continuous(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of scanned files in order, joined over page ends."""
    return scans.continuous(_pages(spark, d))
