"""Command lines of the two jobs (API-03/04) and the service's functions (API-01/02).

    python -m folioscope.cli ingest --root pages/ --out tables/ [--dry-run] [--verbose] [--max-files N] [--preview FILE] [--failed-log DIR] [--extractor M:F] [--ocr M:F]
    python -m folioscope.cli embed --tables tables/ --model hash-64 [--limit N] [--all] [--dry-run]

The defaults read simple PDF files and UTF-8 text with form feeds between pages, without OCR, and
embed by hashed words; ``module:function`` names other functions.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embedding, history
from .operators import ingest as pipeline
from .session import cut, table
from .sources import files, sinks


def health(spark: SparkSession, tables: str) -> dict[str, object]:
    """API-01: whether the tables can be read."""
    try:
        return {"status": "ok", "chunks": table(spark, tables, "chunks", "id").count()}
    except Exception as e:  # noqa: BLE001
        return {"status": "unavailable", "error": type(e).__name__}


def sessions(spark: SparkSession, tables: str, device: str) -> DataFrame:
    """API-02: a device's sessions."""
    return history.device_sessions(table(spark, tables, "chat_sessions"), table(spark, tables, "chat_history"), device)


def messages(spark: SparkSession, tables: str, session: str) -> DataFrame:
    """API-02: a session's messages."""
    return history.session_history(table(spark, tables, "chat_history"), session)


def ingest(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """API-03: files to chunks; a dry run writes only the preview."""
    found = files.discover(spark, a.root, a.ending, a.max_files)
    good, failed = sinks.split_failed(cut(files.extract_pages(found, files.named(a.extractor) if a.extractor else files.automatic, files.named(a.ocr) if a.ocr else None)))
    rows = cut(pipeline.ingest(good, embedding.HashEmbedder(a.dimensions), dry_run=a.dry_run))
    if a.preview:
        sinks.preview(rows, a.preview)
    if a.failed_log:
        failed.select(F.concat_ws("\t", "document_title", "error").alias("value")).write.mode("append").text(a.failed_log)
    if not a.dry_run:
        sinks.append(rows.filter("status = 'success'"), f"{a.out}/chunks.parquet", "chunks")
    for r in failed.select("path", "error").orderBy("path").limit(10).collect():  # the first ten
        print(f"failed: {r.path}: {r.error}")
    if a.verbose:
        pages, ocr = good.agg(F.count("*"), F.count_if("ocr")).first()
        print(f"{pages} pages, {ocr} by OCR")
        rows.groupBy("document_title").agg(F.count("*").alias("chunks")).orderBy("document_title").show(50, False)
    counts = rows.agg(F.count("*"), F.count_if(F.col("status") == "failed")).first()
    return {"files": found.count(), "chunks": counts[0], "failed_chunks": counts[1], "failed_files": failed.count()}


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` beside the table at ``path`` and swap them, so a failed job loses nothing."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new, gone = (hadoop.Path(x) for x in (path, f"{path}.new", f"{path}.old"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    if fs.exists(old) and not fs.rename(old, gone) or not fs.rename(new, old):
        raise OSError(f"{path} could not be replaced; the new rows are in {path}.new")
    fs.delete(gone, True)


def embed(spark: SparkSession, a: argparse.Namespace) -> dict[str, int | None]:
    """API-04: vectors of chunks without one (or of all); a dry run writes nothing."""
    chunks = table(spark, a.tables, "chunks")
    try:
        old = table(spark, a.tables, "document_embeddings")
        old.schema
    except Exception:  # noqa: BLE001
        old = history.empty_tables(spark)["document_embeddings"]
    rows = (chunks if a.limit is None else chunks.orderBy("id").limit(a.limit)) if a.all else embedding.pending(chunks, old, a.model, a.limit)
    done = cut(embedding.results(rows, a.model, embedding.HashEmbedder(a.dimensions), a.dry_run, embedding.Retry(pace=a.pace)))
    if not a.dry_run:
        new = done.filter("status = 'success'").select(F.expr("uuid()").alias("id"), "document_id", "model_name", "embedding")
        replace(embedding.upserted(old, new), f"{a.tables}/document_embeddings.parquet")
    r = embedding.status_counts(done).first()
    return {"succeeded": r.succeeded, "failed": r.failed, "dimensions": r.dimensions}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    job = p.add_subparsers(dest="job", required=True)
    i = job.add_parser("ingest")
    i.add_argument("--root", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--ending", default=".pdf")
    i.add_argument("--max-files", type=int)
    i.add_argument("--preview")
    i.add_argument("--failed-log")
    i.add_argument("--extractor", help="module:function from a file's bytes to the texts of its pages")
    i.add_argument("--ocr", help="module:function from a file's bytes and a page number to its text")
    i.add_argument("--verbose", action="store_true")
    e = job.add_parser("embed")
    e.add_argument("--tables", required=True)
    e.add_argument("--model", default=files.Config().embedding_model)
    e.add_argument("--limit", type=int)
    e.add_argument("--all", action="store_true")
    e.add_argument("--pace", type=float, default=0.0, help="seconds between two batches of a task")
    for q in (i, e):
        q.add_argument("--dry-run", action="store_true")
        q.add_argument("--dimensions", type=int, default=64)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"folioscope {a.job}").getOrCreate()
    out = {"ingest": ingest, "embed": embed}[a.job](spark, a)
    print(out)
    return out


if __name__ == "__main__":
    main()
