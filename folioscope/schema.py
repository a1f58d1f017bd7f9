"""Schemas of the engine's tables (SNK-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _TS, _V = T.StringType(), T.IntegerType(), T.TimestampNTZType(), T.ArrayType(T.FloatType())


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


TABLES = {
    "chunks": _table(("id", _S), ("content", _S), ("embedding", _V), ("document_title", _S), ("source_url", _S), ("manual_type", _S), ("chunk_index", _I), ("page_number", _I), ("chunk_total", _I), ("created_at", _TS)),
    "chat_sessions": _table(("id", _S), ("device_id", _S), ("title", _S), ("created_at", _TS), ("updated_at", _TS)),
    "chat_history": _table(("id", _S), ("session_id", _S), ("device_id", _S), ("user_message", _S), ("bot_response", _S), ("sources", _S), ("manual_type_filter", _S), ("created_at", _TS)),
    "document_embeddings": _table(("id", _S), ("document_id", _S), ("model_name", _S), ("embedding", _V)),
}


def migrated(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns the table has gained since, null where they are missing."""
    schema = TABLES[name]
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def validated(df: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have all ``required`` columns, the others)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok), df.filter(~ok)
