"""Vector functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with ``dim`` finite values that aren't all zero, their unit vectors)."""
    at = np.flatnonzero(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


def cosine_to(df: DataFrame, key: str, vector: str, query: Sequence[float], *more: str) -> DataFrame:
    """MTH-01: (key, more..., similarity) of every row with a usable vector.  Only these columns
    are read; similarities are clamped to [-1, 1]."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)
    kept = [key, *more]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b.column(len(kept)), len(q))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(len(kept))), pa.array(np.clip(x @ q, -1, 1))], names=schema.names)

    return df.select(*kept, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def usable_vector(df: DataFrame, key: str, vector: str, dim: int) -> list[float] | None:
    """The vector of the smallest key with a usable one."""
    finite = F.size(F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) == dim
    row = df.filter(finite & F.exists(vector, lambda x: x != 0)).orderBy(key).select(vector).first()
    return list(row[0]) if row else None
