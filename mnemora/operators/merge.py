"""Incremental merge of extracted memories into the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import word_similarity

KEY = ("owner_id", "memory_type", "key_name")


def content_changed(old_hash: Column, new_hash: Column, old_summary: Column, new_summary: Column) -> Column:
    """The hash differs, or the summaries share under 0.9 of their words (empty ones share none)."""
    return ~old_hash.eqNullSafe(new_hash) | (word_similarity(F.coalesce(old_summary, F.lit("")), F.coalesce(new_summary, F.lit(""))) < 0.9)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. Aggregated as a maximum, so partial results are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def merge_actions(index: DataFrame, extracted: DataFrame) -> DataFrame:
    """What each extracted item does to the index: owner_id, memory_type, key_name, action, confidence, n_items, n_sessions.

    index: the key, content_hash, content_summary, confidence; extracted: the key, content_hash, summary,
    confidence, session, ordinal. Items of one key apply in order, so the last decides; it is created where
    the index has no such key, updated where its confidence is higher by more than 0.1 or its content changed,
    and else left. Confidence is overwritten even by a lower one.
    """
    keys = list(KEY)
    n = extracted.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_distinct("session").alias("n_sessions"))  # the sessions themselves are `links`, as a key may have any number
    last = latest(extracted.select(*keys, "content_hash", "summary", "confidence", "ordinal"), keys, [F.col("ordinal")])
    old = index.select(*keys, F.col("content_hash").alias("h"), F.col("content_summary").alias("s"), F.col("confidence").alias("c"), F.lit(True).alias("known"))
    changed = (F.col("confidence") > F.col("c") + 0.1) | content_changed(F.col("h"), F.col("content_hash"), F.col("s"), F.col("summary"))
    action = F.when(F.col("known").isNull(), "create").when(changed, "update").otherwise("keep")
    return last.join(old, keys, "left").join(n, keys).select(*keys, action.alias("action"), "confidence", "n_items", "n_sessions")


def links(extracted: DataFrame) -> DataFrame:
    """Which sessions contributed to which key: owner_id, memory_type, key_name, session."""
    return extracted.select(*KEY, "session").where("session IS NOT NULL").distinct()


def applied(index: DataFrame, extracted: DataFrame, at: Column) -> DataFrame:
    """The index after the items: the key, content_hash, content_summary, confidence, created_at, updated_at, access_count, change_type.

    index holds each key once, with these columns; extracted as in `merge_actions`. A created row starts without
    accesses; an updated one takes hash, summary and confidence of the last item, even a lower confidence, and keeps
    its creation and accesses; all else stays. change_type is create, update, keep, or none for an untouched row.
    """
    keys = list(KEY)
    last = latest(extracted.select(*keys, "content_hash", "summary", "confidence", "ordinal"), keys, [F.col("ordinal")])
    new = last.select(*keys, F.col("content_hash").alias("_h"), F.col("summary").alias("_s"), F.col("confidence").alias("_c"), F.lit(True).alias("_item"))
    old = index.select(*keys, "content_hash", "content_summary", "confidence", "created_at", "updated_at", "access_count", F.lit(True).alias("_known"))
    changed = (F.col("_c") > F.col("confidence") + 0.1) | content_changed(F.col("content_hash"), F.col("_h"), F.col("content_summary"), F.col("_s"))
    kind = F.when(F.col("_item").isNull(), "none").when(F.col("_known").isNull(), "create").when(changed, "update").otherwise("keep")
    take = F.col("change_type").isin("create", "update")
    return old.join(new, keys, "full").withColumn("change_type", kind).select(
        *keys,
        F.when(take, F.col("_h")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(take, F.col("_s")).otherwise(F.col("content_summary")).alias("content_summary"),
        F.when(take, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("change_type") == "create", at).otherwise(F.col("created_at")).alias("created_at"),
        F.when(take, at).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
        "change_type",
    )


def without_session(index: DataFrame, session: str) -> DataFrame:
    """The index without what a session contributed to, even if others did as well."""
    return index.where(~F.coalesce(F.array_contains("source_sessions", session), F.lit(False)))


def record_access(index: DataFrame, accesses: DataFrame) -> DataFrame:
    """The index after a batch of accesses: id, last_accessed, access_count, consolidation_count.

    accesses: id, n (accesses at once), at (the last of them). Every fifth access consolidates, so the batch adds
    floor((c + n) / 5) - floor(c / 5).
    """
    n = accesses.groupBy("id").agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    c, k = F.coalesce("access_count", F.lit(0)), F.coalesce("n", F.lit(0))
    return index.join(n, "id", "left").select(
        "id",
        F.greatest("last_accessed", "at").alias("last_accessed"),
        (c + k).alias("access_count"),
        (F.coalesce("consolidation_count", F.lit(0)) + F.floor((c + k) / 5) - F.floor(c / 5)).alias("consolidation_count"),
    )


def by_session(index: DataFrame) -> DataFrame:
    """Memories of each source session: session, n_memories, n_types, mean_confidence."""
    return (
        index.select(F.explode("source_sessions").alias("session"), "id", "memory_type", "confidence")
        .distinct()
        .groupBy("session")
        .agg(F.count("*").alias("n_memories"), F.count_distinct("memory_type").alias("n_types"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table with changes applied: the last row of each key by `order`; equal order prefers the change."""
    both = table.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_c"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_c", "_n")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")
