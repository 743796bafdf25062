"""Forgetting: strength decays with time since the last access and slows with consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Daily decay, its slowing by consolidation, and the limits under which a memory is archived and deleted.
DECAY, SLOWING, ARCHIVE, DELETE = 0.1, 0.2, 0.1, 0.02


def strength(confidence: Column, last_accessed: Column, consolidations: Column, as_of: Column) -> Column:
    """confidence * exp(-DECAY days / (1 + SLOWING consolidations)) within 0..1; a null access time counts as now."""
    seconds = F.greatest(F.unix_seconds(as_of) - F.unix_seconds(F.coalesce(last_accessed, as_of)), F.lit(0))
    s = confidence * F.exp(-DECAY * (seconds / 86400.0) / (1 + SLOWING * consolidations))
    return F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))


def actions(index: DataFrame, as_of: str) -> DataFrame:
    """What a clean-up does: id, strength, action. Decided on one snapshot, so nothing is archived and deleted at once."""
    at = F.lit(as_of).cast("timestamp")
    s = strength(F.coalesce("confidence", F.lit(0.0)), F.col("last_accessed"), F.coalesce("consolidation_count", F.lit(0)), at)
    archived = F.coalesce("archived", F.lit(False))
    return index.select("id", "owner_id", F.round(s, 6).alias("strength"), archived.alias("archived")).withColumn(
        "action", F.when(F.col("archived") & (F.col("strength") < DELETE), "delete").when(~F.col("archived") & (F.col("strength") < ARCHIVE), "archive").otherwise("keep")
    )
