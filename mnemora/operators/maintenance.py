"""Keeping index, vectors and files in step, and the state of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_actions(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """What a sync does to each URI: uri, action (add, update, delete, skip), by content hash.

    files: uri, content_hash; vectors: uri, content_hash. Null URIs are left out.
    """
    f = files.where("uri IS NOT NULL").groupBy("uri").agg(F.max("content_hash").alias("fh"), F.lit(True).alias("has_file"))
    v = vectors.where("uri IS NOT NULL").groupBy("uri").agg(F.max("content_hash").alias("vh"), F.lit(True).alias("has_vector"))
    action = F.when(F.col("has_vector").isNull(), "add").when(F.col("has_file").isNull(), "delete").when(~F.col("fh").eqNullSafe(F.col("vh")), "update").otherwise("skip")
    return f.join(v, "uri", "full").select("uri", action.alias("action"))


def rate(part: Column, other: Column) -> Column:
    """part / (part + other); 0 when both are 0."""
    return F.round(F.coalesce(F.try_divide(part, part + other), F.lit(0.0)), 6)


def ready_sessions(sessions: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Whether a session's memories have arrived: thread_id, closed, n_memories, n_vectors, ready.

    sessions: thread_id, status; index: id, file_path, source_sessions; vectors: file_path. Ready means
    closed, with at least one memory and a vector for each.
    """
    held = vectors.where("file_path IS NOT NULL").select("file_path").distinct().withColumn("held", F.lit(True))
    own = index.select(F.explode("source_sessions").alias("thread_id"), "id", "file_path").distinct().join(held, "file_path", "left")
    n = own.groupBy("thread_id").agg(F.count("*").alias("n_memories"), F.count("held").alias("n_vectors"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sessions.join(n, "thread_id", "left").select(
        "thread_id",
        (F.col("status") == "closed").alias("closed"),
        zero("n_memories").alias("n_memories"),
        zero("n_vectors").alias("n_vectors"),
        F.coalesce((F.col("status") == "closed") & (F.col("n_memories") > 0) & (F.col("n_memories") == F.col("n_vectors")), F.lit(False)).alias("ready"),
    )


def participants(sessions: DataFrame) -> DataFrame:
    """Sessions of each participant: participant, n_sessions, n_open. sessions: thread_id, status, participants."""
    return sessions.select(F.explode(F.array_distinct("participants")).alias("participant"), "status").groupBy("participant").agg(F.count("*").alias("n_sessions"), F.count_if(F.col("status") == "active").alias("n_open"))


def unindexed(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages without a vector of their id; both sides hold an id."""
    return messages.join(vectors.select("id").distinct(), "id", "left_anti")


def looked_up(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points by id: id, found, score (1 where found, else null)."""
    held = vectors.select("id").distinct().withColumn("_held", F.lit(True))
    return ids.join(held, "id", "left").select("id", F.coalesce("_held", F.lit(False)).alias("found"), F.when(F.col("_held"), 1.0).alias("score"))
