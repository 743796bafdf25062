"""Messages as text files, and the timelines over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heading of each role (fixed values).
HEADINGS = {"user": "# 👤 User", "assistant": "# 🤖 Assistant", "system": "# ⚙️ System"}


def rendered(role: Column, ident: Column, at: Column, content: Column) -> Column:
    """A message as markdown; null where a part is missing."""
    head = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in HEADINGS.items()])
    stamp = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    return F.concat(head, F.lit("\n\n**ID**: `"), ident, F.lit("`\n**Timestamp**: "), stamp, F.lit(" UTC\n\n## Content\n\n"), content, F.lit("\n"))


def parsed(markdown: Column) -> Column:
    """Struct of role, id, timestamp and content (its non-blank lines up to the next heading) of a rendered message."""
    role = F.coalesce(*[F.when(markdown.startswith(v), F.lit(k)) for k, v in HEADINGS.items()])
    body = F.regexp_extract(markdown, r"(?s)\n## Content\n(.*?)(?:\n## |$)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    ident = F.nullif(F.regexp_extract(markdown, r"\*\*ID\*\*: `([^`]+)`", 1), F.lit(""))
    at = F.try_to_timestamp(F.regexp_extract(markdown, r"\*\*Timestamp\*\*: (\S+ \S+) UTC", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    content = F.nullif(F.array_join(lines, "\n"), F.lit(""))
    return F.when(ident.isNotNull() & content.isNotNull(), F.struct(role.alias("role"), ident.alias("id"), at.alias("timestamp"), content.alias("content")))


def path(thread: Column, ident: Column, at: Column, scheme: str = "mem://") -> Column:
    """Where a message file lies in its session's timeline."""
    return F.concat(F.lit(scheme + "session/"), thread, F.lit("/timeline/"), F.date_format(at, "yyyy-MM/dd/HH_mm_ss"), F.lit("_"), F.left(ident, F.lit(8)), F.lit(".md"))


def timeline(messages: DataFrame) -> DataFrame:
    """Messages per thread at three levels: thread_id, month, day, n_messages, first_at, last_at (null month or day: all).

    One pass with grouping sets; messages: thread_id, id, at.
    """
    m = messages.where("at IS NOT NULL").select("thread_id", "id", "at", F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "dd").alias("day"))
    sets = [["thread_id"], ["thread_id", "month"], ["thread_id", "month", "day"]]
    return m.groupingSets([[F.col(c) for c in s] for s in sets], "thread_id", "month", "day").agg(F.count("*").alias("n_messages"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def message_files(files: DataFrame) -> DataFrame:
    """Visible message files below a timeline, at any depth."""
    name = F.regexp_extract("uri", r"([^/]*)$", 1)
    return files.where(F.col("uri").contains("/timeline/") & F.col("uri").endswith(".md") & ~name.startswith("."))


def loose_id(text: Column) -> Column:
    """The first UUID that follows `ID:` in its line, in lower case; else null."""
    found = F.regexp_extract(text, r"(?i)(?:^|\n)[^\n]*?ID:[ `*]*([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _joined(lines: Column) -> Column:
    """The lines of sorted (key..., line) structs, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n")


def daily_index(messages: DataFrame) -> DataFrame:
    """A thread's day as markdown with its messages in order: thread_id, month, day, markdown. messages: thread_id, id, at."""
    line = F.concat(F.lit("- "), F.date_format("at", "HH:mm:ss"), F.lit(" "), F.left("id", F.lit(8)))
    m = messages.where("at IS NOT NULL").groupBy("thread_id", F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "dd").alias("day"))
    head = F.concat(F.lit("# "), F.col("month"), F.lit("-"), F.col("day"), F.lit("\n\n**Messages**: "), F.col("n").cast("string"), F.lit("\n\n"))
    return m.agg(F.count("*").alias("n"), _joined(F.struct("at", "id", line.alias("line"))).alias("e")).select("thread_id", "month", "day", F.concat(head, F.col("e"), F.lit("\n")).alias("markdown"))


def period_indexes(messages: DataFrame) -> DataFrame:
    """Months with their days and counts, and years (month is the year alone) with their months: thread_id, month, markdown."""
    d = messages.where("at IS NOT NULL").groupBy("thread_id", F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "dd").alias("day")).agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), F.col("day"), F.lit(": "), F.col("n").cast("string"))
    months = d.groupBy("thread_id", "month").agg(F.sum("n").alias("n"), _joined(F.struct("day", line.alias("line"))).alias("e"))
    head = F.concat(F.lit("# "), F.col("month"), F.lit("\n\n**Messages**: "), F.col("n").cast("string"), F.lit("\n\n"))
    years = months.groupBy("thread_id", F.left("month", F.lit(4)).alias("year")).agg(_joined(F.struct(F.concat(F.lit("- "), F.col("month")).alias("line"))).alias("e"))
    of_year = years.select("thread_id", F.col("year").alias("month"), F.concat(F.lit("# "), F.col("year"), F.lit("\n\n"), F.col("e"), F.lit("\n")).alias("markdown"))
    return months.select("thread_id", "month", F.concat(head, F.col("e"), F.lit("\n")).alias("markdown")).unionByName(of_year)


def timeline_text(messages: DataFrame, most: int = 15_000, mark: str = "\n\n[...]") -> DataFrame:
    """A thread's messages in order as one text, cut at `most` characters: thread_id, content. messages: thread_id, id, at, content.

    Only what can be within the limit is gathered: each part has at least its heading's length, so the first rows
    of a thread are enough, and Spark applies that limit before the shuffle.
    """
    head = F.concat(F.lit("\n\n---\n\n## Message: "), F.left("id", F.lit(8)), F.lit("\n\n"))
    m = messages.where("at IS NOT NULL AND content IS NOT NULL").select("thread_id", "at", "id", F.left(F.concat(head, F.col("content")), F.lit(most + 1)).alias("part"))
    total = m.groupBy("thread_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("thread_id").orderBy("at", "id")
    first = m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most // 20 + 1)
    some = first.withColumn("before", F.coalesce(F.sum(F.char_length("part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") <= most)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "")
    c = F.concat(F.lit("# Timeline Messages: "), F.col("total").cast("string"), F.col("p"))
    return some.groupBy("thread_id").agg(parts.alias("p")).join(total, "thread_id").select("thread_id", F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c).alias("content"))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The current version of each session: the one updated last."""
    rest = [c for c in sessions.columns if c != "thread_id"]
    return sessions.groupBy("thread_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("updated_at"), F.col("message_count"), F.col("status"))).alias("x")).select("thread_id", "x.*")
