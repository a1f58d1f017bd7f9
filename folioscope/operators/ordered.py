"""Order-dependent relations that never put a hot group into one task.

The rows of groups of more than ``limit`` rows are cut into buckets of about ``rows`` rows by a
range partitioning over (key, order), whose bounds are sampled quantiles: outlying and equal
positions leave the buckets even.  The cut rows are checkpointed, so every reader sees the same
buckets.  Windows run inside the buckets and the buckets' edges, one row each, are joined
afterwards.  Ordinary groups are one bucket.  Whether there is any hot group is counted first,
over the key column alone; without one, the plain window gives the same rows from a single
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, lookup

#: Rows of a group beyond which it is cut, and rows aimed at in a bucket.
HOT_ROWS, BUCKET_ROWS = 200_000, 50_000


def with_bucket(df: DataFrame, key: str, order: list[Column | str], limit: int = HOT_ROWS, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bucket`` (-1 in ordinary groups, else rising along the order) and ``_hot``."""
    hot = cut(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit))
    total = hot.agg(F.sum("_n")).first()[0] or 0
    marked = lookup(df, hot.filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot")), [key]).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    cold = marked.filter(~F.col("_hot")).withColumn("_bucket", F.lit(-1))
    if not total:
        return cold
    spread = marked.filter("_hot").repartitionByRange(-(-int(total) // rows), F.col(key), *order)
    return cold.unionByName(cut(spread.withColumn("_bucket", F.spark_partition_id())))


def any_hot(keys: DataFrame, key: str, limit: int = HOT_ROWS) -> bool:
    """Whether a value of ``key`` has more than ``limit`` rows."""
    return not keys.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).isEmpty()


def with_neighbours(df: DataFrame, key: str, time: str, tie: str, cols: list[str], hot: bool = True, limit: int = HOT_ROWS, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with structs ``_prev`` and ``_next`` of ``cols`` of the rows before and after it in
    its group by (time, tie); null at the group's ends.  Rows without time must be left out.
    ``hot`` false promises that no group is hot (``any_hot``)."""
    if not hot:
        w = Window.partitionBy(key).orderBy(time, tie)
        return df.withColumn("_row", F.struct(*cols)).withColumns({"_prev": F.lag("_row").over(w), "_next": F.lead("_row").over(w)}).drop("_row")
    b = with_bucket(df, key, [F.col(time), F.col(tie)], limit, rows).withColumn("_row", F.struct(*cols))
    w = Window.partitionBy(key, "_bucket").orderBy(time, tie)
    inner = b.withColumns({"_prev": F.lag("_row").over(w), "_next": F.lead("_row").over(w)})
    order = F.struct(time, tie)
    edges = b.filter("_hot").groupBy(key, "_bucket").agg(F.min_by("_row", order).alias("_first"), F.max_by("_row", order).alias("_last"))
    e = Window.partitionBy(key).orderBy("_bucket")
    edges = edges.select(key, "_bucket", F.lag("_last").over(e).alias("_before"), F.lead("_first").over(e).alias("_after"))
    return (
        inner.join(edges, [key, "_bucket"], "left")
        .withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
        .drop("_before", "_after", "_row", "_bucket", "_hot")
    )


def with_running_total(df: DataFrame, key: str, order: list, value: str, name: str, hot: bool = True, limit: int = HOT_ROWS, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before it in its group, and
    ``{name}_all``, the sum over the group."""
    if not hot:
        w = Window.partitionBy(key)
        before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(before) - F.col(value), f"{name}_all": F.sum(value).over(w)})
    b = with_bucket(df, key, order, limit, rows)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    inner = b.withColumn("_within", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value))
    e = Window.partitionBy(key).orderBy("_bucket")
    edges = b.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    edges = edges.select(key, "_bucket", (F.sum("_sum").over(e.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(key)).alias(f"{name}_all"))
    return inner.join(edges, [key, "_bucket"], "left").withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", "_bucket", "_hot")
