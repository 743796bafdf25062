"""Readers and writers of files: workspaces of text files, index JSON, evaluation sets and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One memory in an index file; what is missing reads as null.
_ENTRY = "STRUCT<id: STRING, file: STRING, memory_type: STRING, key: STRING, content_hash: STRING, source_sessions: ARRAY<STRING>, created_at: TIMESTAMP, updated_at: TIMESTAMP, last_accessed: TIMESTAMP, access_count: BIGINT, confidence: DOUBLE, content_summary: STRING, consolidation_count: BIGINT, archived: BOOLEAN>"


def workspace(spark: SparkSession, root: str, scheme: str = "mem://") -> DataFrame:
    """All files below a folder: uri, text, size, modified. Each file is one row, read whole.

    Spark passes over names that begin with a dot or an underscore, so layer files belong in the memory table.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + "/" + base.lstrip("/") + "/", "")
    return raw.select(F.concat(F.lit(scheme), relative).alias("uri"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files (one JSON document each: memories by id) as rows; a corrupt document counts as empty."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"STRUCT<scope: STRING, owner_id: STRING, memories: MAP<STRING, {_ENTRY}>>").alias("d"))
    rows = parsed.select("d.scope", "d.owner_id", F.explode("d.memories").alias("id", "m"))
    return rows.select("scope", "owner_id", "id", *[F.col(f"m.{c}").alias(c) for c in ("file", "memory_type", "key", "content_hash", "source_sessions", "created_at", "updated_at", "last_accessed", "confidence", "content_summary")], F.coalesce("m.access_count", F.lit(0)).alias("access_count"), F.coalesce("m.consolidation_count", F.lit(0)).alias("consolidation_count"), F.coalesce("m.archived", F.lit(False)).alias("archived"))


def write_index(index: DataFrame, path: str) -> None:
    """Index rows as Parquet, partitioned by scope, so that one scope is read alone."""
    index.write.mode("overwrite").partitionBy("scope").parquet(path)


def migrated(files: DataFrame) -> DataFrame:
    """Index rows for files without one: id and key are the file's stem, confidence 0.5, source `migration`."""
    name = F.regexp_extract("uri", r"([^/]*)$", 1)
    own = files.where(name.endswith(".md") & ~name.startswith("."))
    stem = F.regexp_replace(name, r"\.md$", "")
    return own.select(stem.alias("id"), stem.alias("key"), F.sha2("text", 256).alias("content_hash"), F.lit(0.5).alias("confidence"), F.array(F.lit("migration")).alias("source_sessions"))


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of an evaluation set: sample_id, session_no, text, in numeric order of sessions.

    The file is an array of samples whose conversation maps session_<n> to turns of speaker and text.
    """
    schema = "sample_id STRING, conversation MAP<STRING, STRING>, qa ARRAY<STRUCT<question: STRING, answer: STRING, category: INT>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = raw.select("sample_id", F.explode("conversation").alias("key", "turns")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = F.from_json("turns", "ARRAY<STRUCT<speaker: STRING, text: STRING, blip_caption: STRING>>")
    line = lambda x: F.concat(x["speaker"], F.lit(": "), F.coalesce(x["text"], F.lit("")), F.when(x["blip_caption"].isNotNull(), F.concat(F.lit(" [image: "), x["blip_caption"], F.lit("]"))).otherwise(""))
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("int")
    return each.select("sample_id", number.alias("session_no"), F.array_join(F.transform(turns, line), "\n").alias("text")).orderBy("sample_id", "session_no")


def questions(spark: SparkSession, path: str, without: int = 5) -> DataFrame:
    """Questions of an evaluation set: sample_id, question, answer, category; one category is left out."""
    schema = "sample_id STRING, qa ARRAY<STRUCT<question: STRING, answer: STRING, category: INT>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.*").where(F.col("category") != without)


def plain_cases(spark: SparkSession, path: str) -> DataFrame:
    """Plain test files: blocks between `---` lines, each a message or, after `eval:`, a question: block_no, kind, text."""
    raw = spark.read.text(path, wholetext=True)
    block = raw.select(F.posexplode(F.split("value", r"(?m)^---\n")).alias("block_no", "text"))
    asked = F.col("text").startswith("eval:")
    bare = F.regexp_replace(F.regexp_replace("text", r"^eval:", ""), r"^\s+|\s+$", "")
    return block.where(F.col("text").rlike(r"\S")).select("block_no", F.when(asked, "eval").otherwise("message").alias("kind"), bare.alias("text"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Graded answers, JSON lines or an array: question, category, grade, seconds, tokens."""
    fields = "question: STRING, category: INT, grade: BOOLEAN, time_cost: DOUBLE, token_usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>"
    raw = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"\S"))
    whole = F.from_json("value", f"ARRAY<STRUCT<{fields}>>")
    items = F.explode(F.when(F.trim("value").startswith("["), whole).otherwise(F.transform(lines, lambda x: F.from_json(x, f"STRUCT<{fields}>"))))
    return raw.select(items.alias("r")).select("r.question", "r.category", F.col("r.grade").alias("correct"), F.col("r.time_cost").alias("seconds"), F.col("r.token_usage.total_tokens").alias("tokens"))
