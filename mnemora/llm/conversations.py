"""Rebuilding ordered conversations from loose message rows.

Method: rows are partitioned by conversation key and sorted within it by time (range partitioning on
(conversation, time, id), so that one huge conversation spreads over several tasks), and a finite-state
automaton validates the order of roles. The automaton runs over each piece of a conversation; pieces are
joined by composing their summaries, of which there is at most one per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import batch, not_blank, plain_thread

#: Codes of the automaton's input symbols; anything else is `UNKNOWN`.
USER, ASSISTANT, SYSTEM, UNKNOWN = 0, 1, 2, 3

_SUMMARY = pa.schema(
    [
        ("conversation", pa.string()),
        ("at", pa.int64()),
        ("rows", pa.int64()),
        ("turns", pa.int64()),
        ("first", pa.int8()),
        ("last", pa.int8()),
        ("broken", pa.bool_()),
    ]
)
_SUMMARY_DDL = "conversation string, at long, rows long, turns long, first byte, last byte, broken boolean"


def keyed_messages(messages: DataFrame, role_aliases: DataFrame) -> DataFrame:
    """Messages as the automaton's input: conversation, ts, id, symbol, filled (content is not blank).

    Null or blank thread ids belong to no conversation and are left out. An id may be null: a message is then
    told apart by its other columns, and its id here is "\\x00" and their hash. Extra columns are ignored.
    """
    known = F.broadcast(  # the alias table is fixed and small
        role_aliases.select(F.col("alias").alias("_alias"), F.col("role").alias("_role")).dropna().dropDuplicates(["_alias"])
    )
    symbol = F.when(F.col("_role") == "user", USER).when(F.col("_role") == "assistant", ASSISTANT).when(F.col("_role") == "system", SYSTEM).otherwise(UNKNOWN)
    return (
        messages.select(
            plain_thread(F.col("thread_id")).alias("conversation"),
            F.unix_micros(F.coalesce("sent_at", "created_at")).alias("ts"),
            F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\x00"), F.hex(F.xxhash64("role", "content")))).alias("id"),
            F.col("role").alias("_raw"),
            not_blank(F.col("content")).alias("filled"),
            F.col("content"),
        )
        .where(F.col("conversation").isNotNull())
        .join(known, F.col("_raw") == F.col("_alias"), "left")
        .select("conversation", "ts", "id", symbol.cast("byte").alias("symbol"), "filled", "content")
    )


def sorted_rows(keyed: DataFrame) -> DataFrame:
    """Range partitions in order of (conversation, time, id); equal keys, so redelivered rows, stay together."""
    order = ["conversation", "ts", "id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _same_as_before(key: pa.Array, last: object) -> np.ndarray:
    """Where a row equals the one before it; the first row is compared with `last`."""
    filled = pc.fill_null(key, "") if pa.types.is_string(key.type) else pc.fill_null(key, np.iinfo(np.int64).min)
    a = filled.to_numpy(zero_copy_only=False)
    out = np.empty(len(a), dtype=bool)
    out[1:] = a[1:] == a[:-1]
    out[0] = last is not None and a[0] == last
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run the automaton over sorted rows; one summary for each conversation of each batch, in order."""
    last: tuple[object, object, object] = (None, None, None)
    number = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        conv, ts, ident = rb.column("conversation"), rb.column("ts"), rb.column("id")
        same_conv, same_ts, same_id = _same_as_before(conv, last[0]), _same_as_before(ts, last[1]), _same_as_before(ident, last[2])
        again = same_conv & same_ts & same_id & ~np.asarray(ident.is_null())
        last = (
            conv[-1].as_py(),
            ts[-1].as_py() if ts[-1].is_valid else np.iinfo(np.int64).min,
            ident[-1].as_py() if ident[-1].is_valid else "",
        )
        keep = np.flatnonzero(~again)
        if not len(keep):
            continue
        symbol = rb.column("symbol").to_numpy(zero_copy_only=False)[keep]
        bad = (symbol == UNKNOWN) | ~rb.column("filled").to_numpy(zero_copy_only=False)[keep] | np.asarray(ts.is_null())[keep]
        names = conv.take(pa.array(keep))
        change = np.empty(len(keep), dtype=bool)
        change[0] = True
        arr = names.to_numpy(zero_copy_only=False)
        change[1:] = arr[1:] != arr[:-1]
        start = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        turn = np.flatnonzero(symbol != SYSTEM)
        g, s = group[turn], symbol[turn]
        clash = np.zeros(len(start), dtype=bool)
        repeat = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
        clash[g[1:][repeat]] = True
        broken = np.logical_or.reduceat(bad, start) | clash
        turns = np.bincount(g, minlength=len(start))
        first = np.full(len(start), -1, dtype=np.int8)
        final = np.full(len(start), -1, dtype=np.int8)
        final[g] = s
        first[g[::-1]] = s[::-1]
        yield batch(
            _SUMMARY,
            conversation=arr[start],
            at=np.arange(number, number + len(start)),
            rows=np.diff(np.append(start, len(keep))),
            turns=turns,
            first=first,
            last=final,
            broken=broken,
        )
        number += len(start)


def _piece_order() -> Column:
    """Pieces of a conversation in order: range partitions ascend, and so do pieces within one."""
    return F.col("part").cast("long") * F.lit(1 << 40) + F.col("at")


def verdicts(ordered: DataFrame) -> DataFrame:
    """One row per conversation with messages: conversation, n_messages, n_turns, valid.

    valid is the automaton's verdict: every message has a time, a known role and content, and without the
    system messages the turns begin with user, alternate and end with assistant.
    """
    pieces = (
        ordered.select("conversation", "ts", "id", "symbol", "filled")
        .mapInArrow(_summaries, _SUMMARY_DDL)
        .withColumn("part", F.spark_partition_id())
        .select("conversation", "rows", "broken", "turns", F.struct(_piece_order().alias("o"), "first", "last", "turns").alias("p"))
    )
    joined = pieces.groupBy("conversation").agg(
        F.sum("rows").alias("n_messages"),
        F.sum("turns").alias("n_turns"),
        F.bool_or("broken").alias("broken"),
        F.sort_array(F.collect_list(F.when(F.col("turns") > 0, F.col("p")))).alias("p"),  # at most a piece per partition and batch
    )
    seams = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))),
        lambda i: (i < F.size("p")) & (F.try_element_at("p", i)["last"] == F.try_element_at("p", i + 1)["first"]),
    )
    starts = F.coalesce(F.try_element_at("p", F.lit(1))["first"] == USER, F.lit(False))
    ends = F.coalesce(F.try_element_at("p", F.lit(-1))["last"] == ASSISTANT, F.lit(False))
    return joined.select("conversation", "n_messages", "n_turns", (~F.col("broken") & starts & ends & ~seams).alias("valid"))


def conversations(sessions: DataFrame, messages: DataFrame, role_aliases: DataFrame) -> DataFrame:
    """One row per conversation: thread_id, has_session, n_messages, n_turns, kept.

    Conversations are those of sessions and of messages. kept is false for a conversation without a
    session row, without messages, or with an order the automaton rejects. Empty tables give no rows;
    repeated session versions and redelivered messages count once; among equal times the id decides.
    """
    known = sessions.select(plain_thread(F.col("thread_id")).alias("conversation")).dropna().distinct().withColumn("s", F.lit(True))
    checked = verdicts(sorted_rows(keyed_messages(messages, role_aliases)))
    has = F.coalesce("s", F.lit(False))
    return checked.join(known, "conversation", "full").select(
        F.col("conversation").alias("thread_id"),
        has.alias("has_session"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
        (has & F.coalesce("valid", F.lit(False))).alias("kept"),
    )


def ordered_messages(sessions: DataFrame, messages: DataFrame, role_aliases: DataFrame) -> DataFrame:
    """The messages of kept conversations with their place: thread_id, turn_no, message_id, speaker, sent_at, content.

    A kept conversation alternates strictly, so it is numbered by a window over its own rows.
    """
    kept = conversations(sessions, messages, role_aliases).where("kept").select(F.col("thread_id").alias("conversation"))
    speaker = F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")), F.col("symbol").cast("int") + 1)
    rows = keyed_messages(messages, role_aliases).join(kept, "conversation").dropDuplicates(["conversation", "ts", "id"])
    # Numbered by counting within (conversation, day) and adding the counts of earlier days: a long
    # conversation is then many small windows instead of one.
    day = F.floor(F.col("ts") / F.lit(86_400_000_000))
    from pyspark.sql import Window

    counts = rows.groupBy("conversation", day.alias("day")).count()
    before = counts.withColumn(
        "before", F.sum("count").over(Window.partitionBy("conversation").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    ).select("conversation", "day", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conversation", "day").orderBy("ts", "id"))
    return (
        rows.withColumn("day", day)
        .withColumn("n", within)
        .join(before, ["conversation", "day"])
        .select(
            F.col("conversation").alias("thread_id"),
            (F.col("before") + F.col("n")).alias("turn_no"),
            F.when(~F.col("id").startswith("\x00"), F.col("id")).alias("message_id"),
            speaker.alias("speaker"),
            F.timestamp_micros("ts").alias("sent_at"),
            "content",
        )
    )
