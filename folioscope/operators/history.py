"""Chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import session_title

SOURCE = "array<struct<title:string,url:string,type:string,page:int,similarity:double>>"
NEW = "New Chat"


def once(history: DataFrame) -> DataFrame:
    """Each stored message once."""
    return history.dropDuplicates(["id"])


def message_counts(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """JN-06, AGG-01: messages of every session, 0 included."""
    n = once(history.select("id", "session_id")).groupBy("session_id").agg(F.count("*").alias("message_count"))
    return sessions.join(n, sessions.id == n.session_id, "left").select(sessions.id, "device_id", "title", "created_at", "updated_at", F.coalesce("message_count", F.lit(0)).alias("message_count"))


def device_sessions(sessions: DataFrame, history: DataFrame, device: str | None = None, limit: int = 20) -> DataFrame:
    """HIS-01, SRT-05: the sessions updated last of a device, or of each device.  The window is
    pruned to ``limit`` rows before its shuffle, so a device with many sessions is no burden."""
    own = sessions if device is None else sessions.filter(F.col("device_id") == device)
    order = Window.partitionBy("device_id").orderBy(F.col("updated_at").desc_nulls_first(), "id")
    top = own.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    few = top.select(F.col("id").alias("session_id"))
    n = once(history.select("id", "session_id").join(few, "session_id", "left_semi")).groupBy("session_id").agg(F.count("*").alias("message_count"))
    return top.join(n, top.id == n.session_id, "left").select(top.id, "device_id", "title", "updated_at", "place", F.coalesce("message_count", F.lit(0)).alias("message_count"))


def session_history(history: DataFrame, session: str | None = None) -> DataFrame:
    """HIS-02, JSN-03: messages in order of time with their sources parsed; what isn't a list of
    sources is an empty list."""
    h = once(history if session is None else history.filter(F.col("session_id") == session))
    parsed = F.coalesce(F.from_json("sources", SOURCE), F.array().cast(SOURCE))
    return h.select("session_id", "id", "user_message", "bot_response", parsed.alias("sources"), "created_at").orderBy("session_id", F.col("created_at").asc_nulls_last(), "id")


def flattened(history: DataFrame) -> DataFrame:
    """ARR-03: a row for each side of each message."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("sender"), F.col("user_message").alias("text")), F.struct(F.lit(1).alias("side"), F.lit("bot").alias("sender"), F.col("bot_response").alias("text")))
    return once(history).select("session_id", "id", "created_at", F.inline(sides))


def owned(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """JN-05: messages whose session exists and belongs to their device."""
    keys = sessions.select(F.col("id").alias("session_id"), "device_id")
    return once(history).join(keys, ["session_id", "device_id"], "left_semi")


def create_or_get(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """HIS-03, SNK-06: (device_id, session_id, created) for requests (device_id, session_id): the
    session asked for if it is the device's own, else a new one."""
    keys = sessions.select(F.col("id").alias("_id"), F.col("device_id").alias("_device"))
    r = requests.join(keys, (requests.session_id == keys._id) & (requests.device_id == keys._device), "left")
    return r.select("device_id", F.coalesce("_id", F.expr("uuid()")).alias("session_id"), F.col("_id").isNull().alias("created"))


def new_sessions(opened: DataFrame) -> DataFrame:
    """Rows of chat_sessions for the requests that created one."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return opened.filter("created").select(F.col("session_id").alias("id"), "device_id", F.lit(NEW).alias("title"), now.alias("created_at"), now.alias("updated_at"))


def saved(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """HIS-04, SNK-08: sessions after ``messages`` were saved: a session still called "New Chat"
    takes its first message as title and the time of the last."""
    m = messages.groupBy("session_id").agg(F.min_by("user_message", F.struct("created_at", "id")).alias("_first"), F.max("created_at").alias("_at"))
    s = sessions.join(m, sessions.id == m.session_id, "left")
    new = (F.col("title") == NEW) & F.col("_first").isNotNull()
    return s.select("id", "device_id", F.when(new, session_title(F.col("_first"))).otherwise(F.col("title")).alias("title"), "created_at", F.when(new, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"))


def logged(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """SNK-09, UDF-03: sessions touched by ``messages``: updated_at moves to the last of them."""
    m = messages.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    s = sessions.join(m, sessions.id == m.session_id, "left")
    return s.select("id", "device_id", "title", "created_at", F.coalesce("_at", "updated_at").alias("updated_at"))


def to_json(sources: DataFrame) -> DataFrame:
    """JSN-02: (message_id, sources) as JSON text of citations (message_id, title, ...)."""
    item = F.struct("title", "url", "type", "page", "similarity")
    return sources.groupBy("message_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("sources"))


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """SNK-12: children whose parent still exists."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """SNK-11: the tables with their schemas."""
    from ..schema import TABLES

    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
