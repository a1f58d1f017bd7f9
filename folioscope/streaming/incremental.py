"""Incremental ingest with Structured Streaming (an extension beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Embedder
from ..operators.ingest import ingest
from ..schema import TABLES
from ..sources.sinks import append


def ingest_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str, embedder: Embedder, size: int = 500, overlap: int = 50) -> StreamingQuery:
    """New page files (document_title, page_number, text as Parquet) become chunks; a document's
    pages are expected in one file.  Each micro-batch is one call of the batch pipeline."""
    pages = spark.readStream.schema("document_title string, page_number int, text string").parquet(pages_dir)

    def write(batch: DataFrame, _: int) -> None:
        append(ingest(batch, embedder, size, overlap).filter("status != 'failed'"), out_dir, "chunks")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_counts_stream(spark: SparkSession, history_dir: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Messages by session and time window, late rows accepted for ``late``."""
    from pyspark.sql import functions as F

    rows = spark.readStream.schema(TABLES["chat_history"]).parquet(history_dir).withColumn("at", F.col("created_at").cast("timestamp"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]).groupBy("session_id", F.window("at", width)).agg(F.count("*").alias("messages"))
