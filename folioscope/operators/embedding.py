"""Embedding jobs: pending rows, embedding with status, upsert."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 50


class Embedder(Protocol):
    """A model: its dimensions, and vectors of a batch of texts (None for a failed text)."""

    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float] | None]: ...


class RateLimited(Exception):
    """What a model raises when it is asked too often; ``after`` is the wait it asks for."""

    def __init__(self, after: float | None = None):
        super().__init__(f"rate limited, retry after {after}")
        self.after = after


@dataclass(frozen=True)
class Retry:
    """EMB-01: how often a batch is tried, the seconds before it is tried again (or as long as
    the model asks for), and the seconds between two batches of a task."""

    attempts: int = 3
    pause: float = 5.0
    pace: float = 0.0

    def wait(self, error: Exception) -> float:
        after = error.after if isinstance(error, RateLimited) else None
        return self.pause if after is None else after


class HashEmbedder:
    """EMB-01/02 offline: signed counts of hashed words, of unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


def embed(df: DataFrame, column: str, embedder: Embedder, dry_run: bool = False, retry: Retry = Retry(), batch: int = BATCH) -> DataFrame:
    """EMB-01..03, MTH-05, JN-08: ``df`` with ``embedding``, ``status``, ``error`` and ``latency_ms``, the
    time of its batch's last call (MTH-06).  A batch is tried ``retry.attempts`` times and then
    given up with nulls; a dry run gives zero vectors."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("latency_ms", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column).to_pylist()
            vectors: list = []
            errors: list = []
            took: list = []
            for lo in range(0, len(texts), batch):
                part = [t or "" for t in texts[lo : lo + batch]]
                got, error, ms = [None] * len(part), "no vector", None
                if dry_run:
                    got = [[0.0] * embedder.dimensions] * len(part)
                else:
                    for k in range(retry.attempts):
                        began = time.perf_counter()
                        try:
                            got = embedder(part)
                            break
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"[:500]
                            if k + 1 < retry.attempts:
                                time.sleep(retry.wait(e))
                        finally:
                            ms = 1000 * (time.perf_counter() - began)
                    if retry.pace and lo + batch < len(texts):
                        time.sleep(retry.pace)
                took += [ms] * len(part)
                vectors += got
                errors += [None if v is not None else error for v in got]
            status = ["dry_run" if dry_run else "success" if v is not None else "failed" for v in vectors]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(status, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def query_vector(question: str, embedder: Embedder) -> list[float] | None:
    """EMB-05: the vector of one question, on the driver; None if the model fails."""
    try:
        return embedder([question])[0]
    except Exception:  # noqa: BLE001
        return None


def embed_distinct(df: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """EMB-04: equal texts are embedded once; the vectors are joined back by text."""
    once = embed(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, embedder)
    return df.join(once, column, "left")


def pending(chunks: DataFrame, embeddings: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """JN-04, SRC-04: chunks without a vector of ``model``; a limit counts before they are left out."""
    rows = chunks if limit is None else chunks.orderBy("id").limit(limit)
    have = embeddings.filter(F.col("model_name") == model).select(F.col("document_id").alias("id")).filter("id is not null").distinct()
    return rows.join(have, "id", "left_anti")


def results(rows: DataFrame, model: str, embedder: Embedder, dry_run: bool = False, retry: Retry = Retry()) -> DataFrame:
    """EMB-03: (document_id, model_name, embedding, status, error, latency_ms) of the rows to embed."""
    done = embed(rows.select(F.col("id").alias("document_id"), "content"), "content", embedder, dry_run, retry)
    return done.select("document_id", F.lit(model).alias("model_name"), "embedding", "status", "error", "latency_ms")


def status_counts(done: DataFrame) -> DataFrame:
    """AGG-11: successes, failures and the dimensions of a vector."""
    return done.agg(F.count_if(F.col("status") != "failed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("dimensions"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-03: one row for each (document_id, model_name): the new one, else the old one with
    the largest id."""
    rows = old.select("id", "document_id", "model_name", "embedding", F.lit(0).alias("_new")).unionByName(new.select("id", "document_id", "model_name", "embedding", F.lit(1).alias("_new")))
    order = Window.partitionBy("document_id", "model_name").orderBy(F.desc("_new"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_new")
