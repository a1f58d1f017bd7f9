"""Files, JSON responses and configuration as sources."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pdf import pdf_pages

Extractor = Callable[[bytes], list[str]]


@dataclass(frozen=True)
class Config:
    """SRC-07: settings, taken from an environment by upper-case name."""

    context_limit: int = 8
    similarity_threshold: float = 0.2
    chunk_tokens: int = 500
    overlap_tokens: int = 50
    batch: int = 50
    embedding_model: str = "hash-64"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        return cls(**{f.name: type(f.default)(env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper())})


def discover(spark: SparkSession, root: str, ending: str = ".pdf", limit: int | None = None) -> DataFrame:
    """SRC-01: files below ``root`` by ending in any case, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.lower("path").endswith(ending))
    return files if limit is None else files.orderBy("path").limit(limit)


def plain_text(content: bytes) -> list[str]:
    """UTF-8 text, pages parted by form feeds."""
    return content.decode("utf-8").split("\f")


def automatic(content: bytes) -> list[str]:
    """PDF pages of a PDF file, text pages of any other."""
    return pdf_pages(content) if content.lstrip()[:5] == b"%PDF-" else plain_text(content)


def named(function: str) -> Callable:
    """The function ``module:name``."""
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


_PAGES = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("document_title", T.StringType()), ("page_number", T.IntegerType()), ("text", T.StringType()), ("ocr", T.BooleanType()), ("error", T.StringType()))])


def extract_pages(files: DataFrame, extractor: Extractor = automatic, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """SRC-02/03: (path, document_title, page_number, text, ocr, error); blank pages are read again by
    ``ocr`` if there is one, and an unreadable file gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                title = path.rsplit("/", 1)[-1]
                try:
                    for i, t in enumerate(extractor(content), 1):
                        again = not t.strip() and ocr is not None
                        if again:
                            try:
                                t = ocr(content, i)
                            except Exception:  # noqa: BLE001
                                t = ""
                        rows.append((path, title, i, t, again, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, title, None, None, False, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()))], names=_PAGES.names)

    return files.select("path", "content").mapInArrow(run, _PAGES)


def embedding_response(responses: DataFrame, column: str) -> DataFrame:
    """SRC-06: (index, embedding) rows of JSON responses ``{"data": [{"embedding": [...]}]}``."""
    data = F.from_json(column, "data array<struct<embedding:array<float>>>")["data"]
    return responses.select(F.posexplode(data).alias("index", "item")).select("index", F.col("item.embedding").alias("embedding"))


def embedding_models(responses: DataFrame, column: str) -> DataFrame:
    """SRC-06, FLT-08: model ids that contain "embed" in any case."""
    data = F.from_json(column, "data array<struct<id:string>>")["data"]
    return responses.select(F.explode(data).alias("m")).select(F.col("m.id").alias("id")).filter(F.lower("id").contains("embed"))
