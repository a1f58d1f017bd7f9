"""Answering: requests to prompts to replies to stored messages (CHT-01, RET-07, LLM-01)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from . import retrieval

#: Settings of the chat model.
TEMPERATURE, REPLY_TOKENS = 0.3, 600
RULE = "\n\n---\n\n"
INSTRUCTIONS = "Answer from the manuals below and from nothing else. Name the manual an answer comes from. Say so if they hold no answer."
NO_ANSWER = "No reply could be made just now. Please try again."


class Generator(Protocol):
    """A chat model: replies for a batch of prompts, None for a failed one."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def routed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-09: (requests with a message, blank ones to be refused)."""
    blank = F.coalesce(strip(F.col("message")) == "", F.lit(True))
    return requests.filter(~blank), requests.filter(blank)


def prompt(question: str, documents: DataFrame) -> DataFrame:
    """RET-07, STR-16: one row with the prompt of a question over a retrieved (small) set."""
    blocks = retrieval.context_blocks(documents.withColumn("_rank", F.coalesce(F.col("title_rank"), F.lit(9999))))
    ranks = documents.groupBy("document_title").agg(F.min("title_rank").alias("title_rank"))
    ordered = blocks.join(ranks, "document_title", "left").agg(F.sort_array(F.collect_list(F.struct("title_rank", "document_title", "block"))).alias("b"))
    context = F.array_join(F.transform("b", lambda x: x["block"]), RULE)
    return ordered.select(F.lit(question).alias("message"), F.concat(F.lit(INSTRUCTIONS + "\n\n"), context, F.lit("\n\nQuestion: " + question)).alias("prompt"))


def generate(prompts: DataFrame, generator: Generator, batch: int = 16) -> DataFrame:
    """LLM-01: ``prompts`` with ``reply``; a failed batch gets the fixed message and its error."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("prompt").to_pylist()
            replies: list[str] = []
            errors: list[str | None] = []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                try:
                    got, error = generator([t or "" for t in part]), "no reply"
                except Exception as e:  # noqa: BLE001
                    got, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                replies += [NO_ANSWER if r is None else r for r in got]
                errors += [error if r is None else None for r in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return prompts.mapInArrow(run, schema)


def demo_reply(message: Column, titles: Column) -> Column:
    """STR-18: the reply without a model: the first two titles, or a word on what is missing."""
    low = F.lower(message)
    named = F.array_join(F.slice(F.transform(titles, lambda t: F.coalesce(t, F.lit("Unknown"))), 1, 2), ", ")
    return (
        F.when(F.size(titles) > 0, F.concat(F.lit("Found in "), named, F.lit(". Set up a chat model for a full answer.")))
        .when(low.contains("hello") | low.contains("hi"), "Hello! Ingest some manuals first, then ask again.")
        .when(low.contains("what"), "Good question. It needs ingested manuals to be answered.")
        .otherwise(F.concat(F.lit("You asked: '"), message, F.lit("'. Ingest manuals and set up a chat model first.")))
    )


def chat(chunks: DataFrame, question: str, query: Sequence[float] | None, generator: Generator, manual_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CHT-01 for one question: (reply row, citations).  Without any document the fixed message
    is the reply and the model isn't called."""
    documents = retrieval.retrieve(chunks, question, query, manual_type)
    cited = retrieval.format_sources(documents, ["title_rank", F.col("chunk_index").asc_nulls_last(), "id"])
    if documents.isEmpty():
        row = chunks.sparkSession.createDataFrame([(question, NO_ANSWER, None)], "message string, reply string, error string")
        return row, cited
    return generate(prompt(question, documents), generator).select("message", "reply", "error"), cited
