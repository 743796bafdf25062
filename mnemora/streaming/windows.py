"""Keyed event-time behaviour: counters, debouncing with a cap, count and inactivity triggers. The forms run on
tables; `debounce_stream` is the gap form on a stream with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def event_stats(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events of each kind in one row, and their total: n_<kind>..., total. Other kinds don't count."""
    counted = [F.count_if(F.col("kind") == k) for k in kinds]
    return events.agg(*[c.alias(f"n_{k}") for c, k in zip(counted, kinds, strict=True)], F.count_if(F.col("kind").isin(*kinds)).alias("total"))


def _seconds(gap: str) -> int:
    """The seconds of an interval like `300 seconds`."""
    n, _, unit = gap.partition(" ")
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def _pieces(gap: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (key, t) to the runs of each batch; a batch's first and last run may go on in its neighbours (edge)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            key, t = rb.column(0).to_numpy(zero_copy_only=False), rb.column(1).to_numpy()
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (t[1:] - t[:-1] >= gap)))
            end = np.append(start[1:], len(t))
            edge = np.zeros(len(start), dtype=bool)
            edge[[0, -1]] = True
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(start)), pa.array(t[start]), pa.array(t[end - 1]), pa.array(end - start), pa.array(edge)], schema=schema)

    return run


def runs(events: DataFrame, gap: int) -> DataFrame:
    """Events of a key within `gap` seconds of each other as one run: key, first_at, last_at, n_events. events: key, ts (null times take no part).

    Events are sorted in range partitions of (key, time), so a hot key spreads over tasks; only the runs at the edges
    of a batch, of which each has two at most, are brought together by key and joined where they touch.
    """
    kind = dict(events.dtypes)["key"]
    e = events.where("ts IS NOT NULL").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    schema = pa.schema([("key", to_arrow_type(e.schema["key"].dataType)), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])
    pieces = e.repartitionByRange("key", "t").sortWithinPartitions("key", "t").mapInArrow(_pieces(gap * 1_000_000, schema), f"key {kind}, first long, last long, n long, edge boolean")
    w = Window.partitionBy("key").orderBy("first", "last")
    # Equal times may lie on both sides of an edge, so the run's end so far is the greatest.
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = pieces.where("edge").withColumn("new", F.coalesce((F.col("first") - before >= gap * 1_000_000).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    every = pieces.where("NOT edge").select("key", "first", "last", "n").unionByName(joined.drop("run"))
    return every.select("key", F.timestamp_micros("first").alias("first_at"), F.timestamp_micros("last").alias("last_at"), F.col("n").alias("n_events"))


def debounce(events: DataFrame, gap: str) -> DataFrame:
    """Requests of a key within a gap of each other become one: key, first_at, due_at, n_events. events: key, ts."""
    return runs(events, _seconds(gap)).select("key", "first_at", (F.col("last_at") + F.expr(f"INTERVAL {_seconds(gap)} SECONDS")).alias("due_at"), "n_events")


def debounce_stream(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """`debounce` on a stream, by session windows, which join events exactly a gap apart; those later than the watermark are dropped by Spark."""
    return (
        events.withWatermark("ts", late)
        .groupBy("key", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_events"), F.min("ts").alias("first_at"))
        .select("key", "first_at", F.col("w.end").alias("due_at"), "n_events")
    )


def debounce_capped(events: DataFrame, gap_s: int, cap_s: int) -> DataFrame:
    """`debounce` that fires at the latest cap_s after a burst's first event: key, first_at, due_at, n_events.

    A burst that the cap cuts depends on where the one before ended, so bursts are folded in order. Gaps that
    no burst can span cut the keys into independent runs first, which are then folded apart; finding them takes one
    window over each key.
    events: key, ts.
    """
    e = events.select("key", F.unix_micros("ts").alias("t"))
    w = Window.partitionBy("key").orderBy("t")
    runs = e.withColumn("new", (F.col("t") - F.lag("t").over(w) >= gap_s * 1_000_000).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))

    gap, cap = gap_s * 1_000_000, cap_s * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fold rows sorted by (key, run, t); a run is never split over partitions."""
        at, first, last, n = None, 0, 0, 0
        for pdf in batches:
            out = []
            for key, run, t in zip(pdf["key"], pdf["run"], pdf["t"], strict=True):
                if at is not None and (at != (key, run) or t - last >= gap or t - first >= cap):
                    out.append((at[0], first, min(last + gap, first + cap), n))
                    at = None
                if at is None:
                    at, first, n = (key, run), t, 0
                last, n = t, n + 1
            yield pd.DataFrame(out, columns=["key", "first", "due", "n_events"])
        if at is not None:
            yield pd.DataFrame([(at[0], first, min(last + gap, first + cap), n)], columns=["key", "first", "due", "n_events"])

    ordered = runs.select("key", "run", "t").repartition("key", "run").sortWithinPartitions("key", "run", "t")
    folded = ordered.mapInPandas(fold, "key string, first long, due long, n_events long")
    return folded.select("key", F.timestamp_micros("first").alias("first_at"), F.timestamp_micros("due").alias("due_at"), "n_events")


def inactive(events: DataFrame, idle: str) -> DataFrame:
    """When each key falls idle: key, idle_at, n_events of the activity before. events: key, ts."""
    return debounce(events, idle).select("key", F.col("due_at").alias("idle_at"), "n_events")


def count_triggers(events: DataFrame, every: int) -> DataFrame:
    """Each key's every n-th event fires: key, fired_at, fire_no. events: key, ts, seq (unique, in order of ts)."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq"))
    return events.withColumn("n", n).where(F.col("n") % every == 0).select("key", F.col("ts").alias("fired_at"), (F.col("n") / every).cast("long").alias("fire_no"))


def micro_batches(events: DataFrame, width: str) -> DataFrame:
    """Distinct keys of each tumbling window: window_start, n_keys, n_events."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), "n_keys", "n_events")

