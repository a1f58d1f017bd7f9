"""Table access, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that may be broadcast, in bytes: counted (``lookup``) or estimated by Catalyst.
BROADCAST_BYTES = 64 << 20
#: Parts into which the rows of a key are spread where a lookup is too large to broadcast.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder), pruned to ``columns`` where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimate is at most ``limit``; beyond that the
    join stays a shuffle join chosen by Catalyst."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def counted_bytes(df: DataFrame) -> int:
    """The size of all rows of ``df``, counted: lengths of texts and of lists of texts, 16 bytes for
    any other value and element."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array":
            size = size + 16 * F.greatest(F.size(f.name), F.lit(0))
            if f.dataType.elementType.typeName() == "string":
                size = size + F.octet_length(F.concat_ws("", f.name))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right``, a checkpointed relation with one row for each key.

    The size of ``right`` is counted.  Up to ``limit`` it is broadcast; beyond that the rows of
    every key of ``left`` are spread over ``salts`` parts by a hash of all their columns, so no
    task gets a hot key whole, and ``right`` is repeated once for each part.  The columns are
    those of ``left`` in their order and then the new ones.
    """
    names = [*left.columns, *(c for c in right.columns if c not in on and "semi" not in how and "anti" not in how)]
    if counted_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how).select(names)
    plain = [F.col(f.name) for f in left.schema.fields if f.dataType.typeName() != "map"]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).select(names)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a local master, whose executors
    share the machine, may do without the setting; a cluster without it is an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "folioscope-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that lost executors cost one read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_sample(df: DataFrame, key: str, limit: int, rows: int, *then: Column) -> DataFrame:
    """At most ``limit`` rows of ``df`` in the order of a hash of ``key``.  ``rows`` is the size
    of the whole table (or more): by it about half more than the limit pass the hash, so every
    task sends few rows, however many tasks there are.  ``then`` orders rows of one key."""
    share = (1.5 * limit + 500) / max(1, rows)
    h = F.xxhash64(key)
    if share < 1:
        df = df.filter(h < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(h, key, *then).limit(limit)
